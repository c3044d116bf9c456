"""Moderation analytics for Ethiopic-script message threads, on Spark DataFrames."""

__version__ = "0.1.0"
