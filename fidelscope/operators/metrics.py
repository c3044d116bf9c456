"""Evaluation of predictions: accuracy, per-class report, confusion matrix.

All of them read one small table of (label, prediction) counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelscope.functions import labels as lb
from fidelscope.functions import script

CLASSES = tuple(sorted(script.LABEL_NAMES))


def pair_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per pair of true and predicted class."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows whose prediction is their label."""
    hit = F.col(label) == F.col(prediction)
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"))


def known_pairs(df: DataFrame, label: str, prediction: str, classes: Sequence[int]) -> DataFrame:
    """Pair counts; a label or prediction outside ``classes`` is an error when they are read."""
    named = F.col("label").isin(*classes) & F.col("prediction").isin(*classes)
    problem = F.raise_error(F.concat(
        F.lit(f"classes are {list(classes)}, found label "), F.col("label").cast("string"),
        F.lit(", prediction "), F.col("prediction").cast("string")))
    checked = F.when(F.coalesce(named, F.lit(False)), F.col("n")).otherwise(problem.cast("bigint"))
    return pair_counts(df, label, prediction).withColumn("n", checked)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_report(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """``name, precision, recall, f1, support`` per class, then accuracy and both averages.

    A class that never occurs has zero support; divisions by zero give 0.  The accuracy row
    holds the value in all three measures.  A class outside ``classes`` is an error.
    """
    pairs = known_pairs(df, label, prediction, classes)
    true, predicted, n = F.col("label"), F.col("prediction"), F.col("n")

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    # One aggregate row over at most k² pairs, unfolded into one row per class.
    per_class = F.array(
        *(
            F.struct(
                F.lit(c).alias("class"),
                rows_where((true == c) & (predicted == c)).alias("hits"),
                rows_where(predicted == c).alias("predicted"),
                rows_where(true == c).alias("support"),
            )
            for c in classes
        )
    )
    counted = pairs.agg(
        F.sum("n").alias("total"), rows_where(true == predicted).alias("right"),
        per_class.alias("by_class"),
    )
    rates = counted.select(
        "total", "right", F.inline("by_class")
    ).select(
        "total", "right", "class", "support",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
    ).withColumn(
        "f1",
        _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )
    measures = ("precision", "recall", "f1")
    share = _ratio(F.col("right"), F.col("total"))
    overall = rates.groupBy("total", "right").agg(
        *(F.avg(m).alias(f"macro_{m}") for m in measures),
        *(
            _ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")
            for m in measures
        ),
    )
    averages = overall.select(
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("name"), *(share.alias(m) for m in measures),
                         F.col("total").alias("support")),
                *(
                    F.struct(F.lit(f"{kind} avg").alias("name"),
                             *(F.col(f"{kind}_{m}").alias(m) for m in measures),
                             F.col("total").alias("support"))
                    for kind in ("macro", "weighted")
                ),
            )
        )
    )
    return rates.select(lb.label_name("class").alias("name"), *measures, "support").unionByName(
        averages
    )


def confusion_matrix(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """``label, predicted_0, predicted_1, …``: rows are true classes, columns predictions.

    Every class of ``classes`` has a row and a column; any other class is an error.
    """
    pairs = known_pairs(df, label, prediction, classes)
    cells = F.array(
        *(
            F.struct(
                F.lit(t).alias("label"),
                *(
                    F.coalesce(
                        F.sum(
                            F.when((F.col("label") == t) & (F.col("prediction") == p), F.col("n"))
                        ),
                        F.lit(0),
                    ).alias(f"predicted_{p}")
                    for p in classes
                ),
            )
            for t in classes
        )
    )
    return pairs.agg(cells.alias("cells")).select(F.inline("cells")).orderBy("label")
