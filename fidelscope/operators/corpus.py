"""The labelled corpus: statistics, labels, split and class weights."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelscope.functions import labels as lb
from fidelscope.functions import script
from fidelscope.operators.selection import rank_cutoffs


def label_distribution(df: DataFrame, column: str = "label") -> DataFrame:
    """Rows per label, most frequent first; nulls are not counted."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), column)
    )


def distinct_labels(df: DataFrame, column: str = "label") -> DataFrame:
    """The labels that occur."""
    return df.select(column).distinct()


def corpus_stats(df: DataFrame, column: str = "processed") -> DataFrame:
    """One row: texts, and texts with something left after cleaning."""
    return df.agg(
        F.count("*").alias("samples"), F.count_if(F.col(column) != "").alias("usable_samples")
    )


def coerce_labels(df: DataFrame, column: str = "label") -> DataFrame:
    """Turn labels into integer codes; the column as a whole decides how.

    If every label is a number they are codes already, otherwise every label must be a name.
    One aggregate over the column; the first rule that no row breaks is applied.
    """
    label = F.col(column).cast("string")
    number = label.try_cast("double")
    whole = number.isNotNull() & ~F.isnan(number) & (number == F.floor(number))
    seen = df.agg(
        F.count("*").alias("n"),
        F.count_if(whole).alias("codes"),
        F.count_if(lb.label_code(label).isNotNull()).alias("names"),
    ).first()
    if seen.codes == seen.n:
        return df.withColumn(column, number.cast("int"))
    if seen.names == seen.n:
        return df.withColumn(column, lb.label_code(label))
    raise ValueError(
        f"labels are neither all numbers ({seen.codes} of {seen.n}) "
        f"nor all known names ({seen.names} of {seen.n})"
    )


def check_labels(df: DataFrame, column: str = "label") -> None:
    """Raise for codes that have no name: the evaluation could not name their class."""
    label = F.col(column)
    odd = F.when(~label.isin(*script.LABEL_NAMES), label)
    seen = df.agg(F.count(odd).alias("n"), F.min(odd).alias("least"), F.max(odd).alias("most")).first()
    if seen.n:
        raise ValueError(
            f"{seen.n} labels from {seen.least} to {seen.most} are none of {sorted(script.LABEL_NAMES)}"
        )


def split_quotas(counts: dict[int, int], test_share: float = script.TEST_SHARE) -> dict[int, int]:
    """Test rows per label: ``ceil(share·n)`` in all, training shares by largest remainder.

    Equal remainders are served in label order.
    """
    n = sum(counts.values())
    n_train = n - math.ceil(Fraction(str(test_share)) * n)
    exact = {c: Fraction(k * n_train, n) for c, k in counts.items()}
    train = {c: math.floor(x) for c, x in exact.items()}
    spare = n_train - sum(train.values())
    for c in sorted(exact, key=lambda c: (train[c] - exact[c], c))[:spare]:
        train[c] += 1
    return {c: counts[c] - train[c] for c in counts}


def stratified_split(
    df: DataFrame,
    test_share: float = script.TEST_SHARE,
    seed: int = script.SEED,
    key: str = "id",
    column: str = "label",
) -> DataFrame:
    """Add ``part`` (``train`` or ``test``) with exact shares per label.

    The test part of a label is its first rows by ``md5(seed|key)``: the same rows whatever the
    partitioning.  Only one row per label reaches the driver, and no label is ranked in one
    task (:func:`rank_cutoffs`).
    """
    counts = {r[column]: r["n"] for r in df.groupBy(column).agg(F.count("*").alias("n")).collect()}
    if not counts:
        raise ValueError("no rows to split")
    if min(counts.values()) < 2:
        raise ValueError(f"a label has a single row: {counts}")
    quotas = split_quotas(counts, test_share)
    tested = sum(quotas.values())
    if min(tested, sum(counts.values()) - tested) < len(counts):
        raise ValueError(f"a part of the split has fewer rows than there are labels: {quotas}")
    takes = df.sparkSession.createDataFrame(
        [(c, q) for c, q in sorted(quotas.items()) if q],
        f"{column} {df.schema[column].dataType.simpleString()}, take BIGINT",
    )
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    order = F.struct(digest.alias("digest"), F.col(key).alias("key"))
    rows = df.select(column, order.alias("order"), F.substring(digest, 1, 4).alias("bucket"))
    # One row per label: as constants they need no join on a key with a handful of values.
    cutoffs = rank_cutoffs(rows, takes, [column]).select(column, "cutoff").collect()
    part = F.lit("train")
    for label, last in cutoffs:
        own_key = F.lit(last["key"]).cast(df.schema[key].dataType)
        limit = F.struct(F.lit(last["digest"]).alias("digest"), own_key.alias("key"))
        part = F.when((F.col(column) == label) & (order <= limit), "test").otherwise(part)
    return df.withColumn("part", part)


def class_weights(df: DataFrame, column: str = "label") -> DataFrame:
    """Balanced weight per label, ``n / (k · n_label)``."""
    sizes = df.groupBy(column).agg(F.count("*").alias("rows"))
    whole = sizes.agg(F.sum("rows").alias("n"), F.count("*").alias("k"))
    n, k = whole.select("n").scalar(), whole.select("k").scalar()
    return sizes.withColumn("weight", n / (k * F.col("rows")))
