"""Exact deduplication against a persistent digest index (operator 9), native.

The index is a table of the digests seen so far, bucketed and sorted by digest.  New data is
reduced to one row per digest, anti-joined with the index by a sort-merge join that needs no
exchange of the index, and what remains is appended.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelscope.llm.common import join_by_key, unused
from fidelscope.session import checkpoint_folder, stage


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, as lower-case hex; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far with the id that was kept, in a folder that all executors share.

    A folder that exists is opened again, also by a later session; ``buckets`` is fixed when the
    index is made (the session's number of shuffle partitions, if not given).
    """

    COLUMNS = "digest STRING, keep_id BIGINT"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{checkpoint_folder(spark).rstrip('/')}/digests-{uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digests_{uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({self.COLUMNS}) USING parquet CLUSTERED BY (digest)"
            f" SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` (one per digest) whose digest is not in the index."""
        return groups.join(self.frame().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        groups.select("digest", "keep_id").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


@dataclass
class ExactDedup:
    """``rows``: one for each document, with its digest, group and verdict.  ``index``: as grown."""

    rows: DataFrame
    index: DigestIndex


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> ExactDedup:
    """Mark one row of each group of equal texts, unless the index has the text already.

    ``docs`` needs ``doc_id`` and ``text``; other columns are left out of ``rows``, which has
    ``doc_id, row, digest, keep_id, group_size, kept``.  ``row`` numbers the rows of the scan.

    * A null text equals an empty text.
    * Of equal texts in ``docs`` the largest doc_id stays (null is smallest); of rows repeated
      with the same doc_id the one read last.
    * A text that the index knows stays with the id stored there; all its rows are dropped.
    * ``group_size`` counts rows of ``docs`` only.  An empty table gives no rows.

    Groups are combined before the shuffle, and hot digests are looked up by broadcast.  Without an
    ``index`` a new one is made, whose name is forgotten afterwards; its files stay at ``index.path``.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark)
    slim = stage(
        docs.select(
            "doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("digest")
        )
    )
    groups = stage(
        slim.groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size"))
        .select("digest", "group_size", F.col("last.doc_id").alias("keep_id"),
                F.col("last.row").alias("keep_row"))
    )
    fresh = stage(index.unseen(groups))
    known = groups.join(fresh.select("digest"), "digest", "left_anti").drop("keep_id", "keep_row")
    stored = index.frame()
    entries = fresh.unionByName(known.join(stored, "digest"), allowMissingColumns=True)
    entries = stage(entries)
    index.append(fresh)
    if own:
        index.close()
    rows = join_by_key(slim, entries, "digest", "group_size", slim.count())
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
    return ExactDedup(rows.withColumn("kept", kept).drop("keep_row"), index)


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``docs`` must be a plain scan, so that both reads number its rows alike.  One row of each text
    stays: null and empty texts are one text, rows repeated whole leave one, an empty table stays empty.
    """
    row = unused(docs, "row")
    kept = deduplicate(docs, index).rows.where("kept").select(F.col("row").alias(row))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(kept, row, "left_semi").select(*docs.columns)
