"""Texts to sentences to cleaned sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelscope.functions import text as tx
from fidelscope.functions.once import with_computed


def non_blank(df: DataFrame, column: str = "processed") -> DataFrame:
    """Rows whose cleaned text is not empty."""
    return df.where(F.col(column) != "")


def explode_sentences(df: DataFrame, column: str = "text") -> DataFrame:
    """One row per sentence with its position; the text column is replaced."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.posexplode(tx.split_sentences(column)).alias("sent_idx", "original"))


def prepare_sentences(df: DataFrame, column: str = "text", **cleaning) -> DataFrame:
    """Sentences with their cleaned form beside them, where something is left of it.

    The explode stands between splitting and cleaning, so each runs once, on plain strings.
    """
    cleaned = tx.clean_text("original", **cleaning)
    return non_blank(with_computed(explode_sentences(df, column), processed=cleaned))
