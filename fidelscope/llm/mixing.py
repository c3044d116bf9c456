"""Mixing sources by temperature (operator 5), native.

A source's share of all tokens is raised to an exponent between 0 and 1, the smaller the flatter.
The exponent is bisected until the mixture meets a target entropy, or until no source is repeated
more often than a limit.  Each source then gets its part of the token budget as a stream of
permutations of its documents, the last one cut where the budget ends, and every stream is laid
evenly over the blocks of the mixture, so that each block has the target weights.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fidelscope.llm.common import WORD, join_by_key, unused
from fidelscope.session import stage

MAX_REPETITION = 2.0
BISECTIONS = 20
BLOCKS = 64
SEED = "mix"
#: Documents are ranked in pieces of about so many, cut by their permutation keys.
PIECE = 4_096


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight(exponent: float) -> Column:
    return F.pow("p", F.lit(exponent))


def bisect(
    shares: DataFrame, max_repetition: float | None, target_entropy: float | None, budget: int | None
) -> float:
    """The exponent, by repeated aggregates over ``shares`` (``tokens, p`` of each source)."""

    def flat_enough(exponent: float) -> bool:
        norm = F.sum(weight(exponent))
        if target_entropy is not None:
            spread = F.sum(weight(exponent) * F.lit(exponent) * F.log("p"))
            value = shares.agg((F.log(norm) - spread / norm).alias("x")).first()["x"]
            return value is not None and value >= target_entropy
        ratio = weight(exponent) / F.col("p")
        most = F.max(ratio) / (F.min(ratio) if budget is None else norm * F.sum("tokens") / F.lit(float(budget)))
        value = shares.agg(most.alias("x")).first()["x"]
        return value is None or value <= max_repetition

    low, high = 0.0, 1.0
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        # Entropy falls with the exponent, and so does the most frequent repetition.
        if flat_enough(middle) == (target_entropy is None):
            high = middle
        else:
            low = middle
    return high if target_entropy is None else low


@dataclass
class Mixture:
    """``rows``: one for each copy of a document.  ``sources``: weight and budget of each source."""

    rows: DataFrame
    sources: DataFrame
    exponent: float


def mix(
    docs: DataFrame,
    max_repetition: float | None = MAX_REPETITION,
    target_entropy: float | None = None,
    budget: int | None = None,
    blocks: int = BLOCKS,
    seed: str = SEED,
) -> Mixture:
    """The mixture as ``doc_id, row, source, n_tokens, copy, block``.

    Tokens are words.  Without ``budget`` it is the smallest one that cuts no source, so every
    document comes at least once, and as often as ``max_repetition`` at most, rounded up.  With
    ``target_entropy`` (in nats) that is met instead.  A null source is the source ``''``; a
    source without any token comes once.  Rows repeated with one doc_id are documents of their
    own.  ``row`` numbers the rows of the scan; other columns of ``docs`` are left out.

    Running token sums are taken within small pieces of a source, cut by hash, and over the
    pieces' totals, so that no source is ranked in one task.
    """
    slim = stage(docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), count_tokens(F.col("text")).alias("n_tokens"),
    ))
    sources = stage(slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")))
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("documents"), F.lit(0))).first()
    shares = stage(sources.where("tokens > 0").select(
        "source", "tokens", (F.col("tokens") / F.lit(float(max(total[0], 1)))).alias("p")))
    exponent = bisect(shares, max_repetition, target_entropy, budget)
    norm = shares.agg(F.sum(weight(exponent))).first()[0] or 1.0
    weights = shares.withColumn("weight", weight(exponent) / F.lit(norm))
    if budget is None:
        budget = weights.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    plan = stage(
        sources.join(weights.select("source", "weight"), "source", "left")
        .withColumn("budget", F.round(F.coalesce(F.col("weight") * F.lit(float(budget)), F.lit(0.0))).cast("long"))
        .withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
        .withColumn("pieces", F.ceil(F.col("documents") / PIECE))
    )
    spread = join_by_key(slim, plan.drop("weight"), "source", "documents", total[1])
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("copy"), F.coalesce("doc_id", F.lit(-1))))
    part = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    copies = stage(
        spread.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
        .where("copy < whole OR rest > 0").withColumn("key", key)
        .withColumn("piece", F.shiftright(part * F.col("pieces"), 32))
    )
    ahead = Window.partitionBy("source", "copy").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = copies.groupBy("source", "copy", "piece").agg(F.sum("n_tokens").alias("in_piece"))
    before = totals.select("source", "copy", "piece", F.coalesce(F.sum("in_piece").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "copy", "piece").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    ranked = copies.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, ["source", "copy", "piece"])
    upto = F.col("upto") + F.col("before")
    start = F.col("copy") * F.col("tokens") + upto - F.col("n_tokens")
    block = F.when(F.col("budget") > 0, F.least(
        F.floor(start.cast("decimal(38,0)") * blocks / F.col("budget")), F.lit(blocks - 1))).otherwise(0)
    rows = ranked.where((F.col("copy") < F.col("whole")) | (upto <= F.col("rest"))).select(
        "doc_id", "row", "source", "n_tokens", "copy", block.cast("long").alias("block"))
    return Mixture(rows, plan.select("source", "documents", "tokens", "weight", "budget"), exponent)


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, a plain scan, each as often as the mixture has it.

    Every row comes at least once.  A null or empty text has no token and takes no budget; rows repeated with one
    doc_id are rows of their own; an empty table stays empty.
    """
    row, times = unused(docs, "row"), unused(docs, "times")
    counts = mix(docs, **options).rows.groupBy("row").agg(F.count("*").alias(times))
    counts = counts.withColumnRenamed("row", row)
    numbered = docs.withColumn(row, F.monotonically_increasing_id()).join(counts, row)
    again = numbered.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return again.select(*docs.columns)
