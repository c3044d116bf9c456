"""Input tables: labelled corpus, messages, chats, analysis requests.

``partitions`` deals the rows out anew, for a table in fewer splits than the cluster has cores;
without it the scan's own splits stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CORPUS_SCHEMA = "id BIGINT, text STRING, label STRING"
MESSAGE_SCHEMA = "chat_id BIGINT, message_id BIGINT, reply_to BIGINT, text STRING"
CHAT_SCHEMA = "chat_id BIGINT, username STRING, kind STRING, title STRING, linked_chat_id BIGINT"
REQUEST_SCHEMA = "request_id BIGINT, url STRING, message_limit STRING"


def _read(
    spark: SparkSession, path: str, schema: str, fmt: str, partitions: int | None, **options: str
) -> DataFrame:
    if fmt == "csv":
        # Texts hold quotes and line breaks.
        options = {"header": "true", "multiLine": "true", "escape": '"', **options}
    rows = spark.read.schema(schema).options(**options).format(fmt).load(path)
    return rows.repartition(partitions) if partitions else rows


def read_corpus(
    spark: SparkSession, path: str, fmt: str = "parquet", partitions: int | None = None, **options: str
) -> DataFrame:
    """Training part of a labelled corpus: ``id, text, label`` (codes or names)."""
    return _read(spark, path, CORPUS_SCHEMA, fmt, partitions, **options)


def read_messages(
    spark: SparkSession, path: str, fmt: str = "parquet", partitions: int | None = None, **options: str
) -> DataFrame:
    """Exported messages.  Written partitioned or clustered by ``chat_id``, a scan reads only
    the chats that a job asks for."""
    return _read(spark, path, MESSAGE_SCHEMA, fmt, partitions, **options)


def read_chats(
    spark: SparkSession, path: str, fmt: str = "parquet", partitions: int | None = None, **options: str
) -> DataFrame:
    """Known chats: channels, groups and users, with the discussion chat of a channel."""
    return _read(spark, path, CHAT_SCHEMA, fmt, partitions, **options)


def read_requests(
    spark: SparkSession, path: str, fmt: str = "parquet", partitions: int | None = None, **options: str
) -> DataFrame:
    """Analysis requests: a channel or post URL and a message limit as typed."""
    return _read(spark, path, REQUEST_SCHEMA, fmt, partitions, **options)
