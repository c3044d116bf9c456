"""Ranks, as-of merges and running sums per key, without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places on an order's line that one group of an as-of merge or running sum covers.
SPAN = 65_536


def asof_steps(
    rows: DataFrame, steps: DataFrame, keys: Sequence[str], at: str, step: str, span: int = SPAN
) -> DataFrame:
    """Rows of ``rows`` with the greatest ``step`` of their key that is not above ``at``, if any.

    ``rows`` holds the keys and a whole number ``at``; ``steps`` the keys, ``step`` and whatever is to
    come along with it, one row per key and step.  Rows without such a step are dropped.

    Both sides are laid on one line per key, cut into blocks of ``span`` places.  Within a block the
    last step is carried along the line; what a block starts with follows from one row per block.  So
    the cost grows with rows and steps, not with their product, and no task sees more of a key than
    one block's rows or one line of blocks.
    """
    keys = list(keys)
    carried = [c for c in steps.columns if c not in keys]
    line = rows.select("*", F.col(at).cast("bigint").alias("_place"), F.lit(True).alias("_row")).unionByName(
        steps.select(
            *keys, F.struct(*carried).alias("_step"), F.col(step).cast("bigint").alias("_place"),
            F.lit(False).alias("_row"),
        ),
        allowMissingColumns=True,
    ).withColumn("_block", F.floor(F.col("_place") / F.lit(span)))
    # A step comes before the rows at its own place.
    along = Window.partitionBy(*keys, "_block").orderBy("_place", "_row")
    inside = line.withColumn("_step", F.last("_step", ignorenulls=True).over(along)).where("_row")
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        line.groupBy(*keys, "_block").agg(F.max_by("_step", F.when(~F.col("_row"), F.col("_place"))).alias("_last"))
        .select(*keys, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    )
    found = inside.join(before, [*keys, "_block"]).withColumn("_step", F.coalesce("_step", "_before"))
    return found.where(F.col("_step").isNotNull()).select(
        *rows.columns, *(F.col(f"_step.{c}").alias(c) for c in carried)
    )


def running_sums(
    rows: DataFrame, keys: Sequence[str], order: Column, sums: Sequence[str], span: int = SPAN
) -> DataFrame:
    """``rows`` with ``sums`` replaced by their running sums per key along ``order``, a whole number.

    Nulls count as nothing.  Sums run within blocks of ``span`` places; what came before a block is
    added from one row per block, so a key of any size is summed by many tasks.
    """
    keys = list(keys)
    line = rows.withColumn("_place", order.cast("bigint")).withColumn(
        "_block", F.floor(F.col("_place") / F.lit(span))
    )
    along = Window.partitionBy(*keys, "_block").orderBy("_place")
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = line.groupBy(*keys, "_block").agg(*(F.sum(c).alias(f"_b_{c}") for c in sums)).select(
        *keys, "_block", *(F.sum(f"_b_{c}").over(earlier).alias(f"_b_{c}") for c in sums)
    )
    summed = line.withColumns({c: F.sum(c).over(along) for c in sums}).join(before, [*keys, "_block"])
    both = {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_b_{c}", F.lit(0)) for c in sums}
    return summed.withColumns(both).select(*rows.columns)


def rank_cutoffs(rows: DataFrame, takes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ``order`` value of the ``take``-th row of each key, null where a key has fewer rows.

    ``rows`` holds the keys, a unique ``order`` value and a coarse ``bucket`` that grows with
    it; ``takes`` holds the keys and ``take``.  Rows are first counted per bucket (combined
    before the shuffle), the bucket that holds the wanted rank is found by an as-of merge of the
    takes with the running counts, and only the rows of that bucket are ranked.  So no task sees
    more of a hot key than its buckets or one bucket's rows, and any number of takes works.
    """
    keys = list(keys)
    earlier = (
        Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(earlier), F.lit(0))
    )
    edges = (
        asof_steps(
            takes.where("take > 0").select(*keys, "take", (F.col("take") - 1).alias("_wanted")),
            counted, keys, "_wanted", "before",
        )
        .where(F.col("take") <= F.col("before") + F.col("n"))
        .select(*keys, "bucket", "take", (F.col("take") - F.col("before")).alias("rank"))
    )
    ranked = rows.join(
        edges.select(*keys, "bucket").distinct(), [*keys, "bucket"], "left_semi"
    ).withColumn(
        "rank",
        F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("order")).cast("long"),
    )
    cutoffs = ranked.join(edges, [*keys, "bucket", "rank"]).select(
        *keys, "take", F.col("order").alias("cutoff")
    )
    return takes.join(cutoffs, [*keys, "take"], "left")
