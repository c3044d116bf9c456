"""Cleaning and scoring of a message stream.

Splitting, cleaning, weighting and prediction look at one message at a time, so the batch
expressions run on a stream as they are: no state, no watermark.  Shares and samples compare
messages with each other and stay with the batch report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fidelscope.operators.model import TextModel
from fidelscope.operators.scoring import score_sentences
from fidelscope.operators.threads import with_text
from fidelscope.sources.tables import MESSAGE_SCHEMA


def stream_messages(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Message files as they arrive in a folder."""
    return spark.readStream.schema(MESSAGE_SCHEMA).options(**options).format(fmt).load(path)


def score_stream(messages: DataFrame, model: TextModel, **cleaning) -> DataFrame:
    """Scored sentences of a message stream."""
    return score_sentences(with_text(messages), model, **cleaning)


def write_scored(
    scored: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger
) -> StreamingQuery:
    """Append scored sentences to ``path``, exactly once per input file."""
    writer = scored.writeStream.format(fmt).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start(path)
