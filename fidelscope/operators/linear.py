"""Linear classifier: one-vs-rest logistic regression and its prediction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelscope.functions import labels as lb
from fidelscope.functions import script
from fidelscope.functions.once import let, with_fields
from fidelscope.operators.features import (
    count_terms,
    literal_doubles,
    row_weights,
    term_freq,
)
from fidelscope.operators.logistic import minimise, sparse_blocks
from fidelscope.operators.model import TextModel
from fidelscope.session import stage

#: A fit ends when its gradient has shrunk to this share of the first one.
TOLERANCE = 1e-6


def feature_vectors(
    df: DataFrame, terms: Sequence[str], idf: Sequence[float], column: str = "processed"
) -> DataFrame:
    """Add ``features``: the normalised TF-IDF vector with a constant 1 behind it.

    The constant stands for the intercept, so that training penalises it like any weight.
    """
    scaled = ElementwiseProduct(
        scalingVec=Vectors.dense(list(idf)), inputCol="term_counts", outputCol="_scaled"
    ).transform(count_terms(df, terms, column))
    unit = Normalizer(p=2.0, inputCol="_scaled", outputCol="_unit").transform(scaled)
    joined = VectorAssembler(inputCols=["_unit", "_one"], outputCol="features").transform(
        unit.withColumn("_one", F.lit(1.0))
    )
    return joined.drop("term_counts", "_scaled", "_unit", "_one")


def fit_ovr(
    df: DataFrame,
    column: str = "label",
    max_iter: int = script.MAX_ITER,
    tol: float = TOLERANCE,
    c: float = 1.0,
    width: int | None = None,
    partitions: int | None = None,
) -> tuple[tuple[int, ...], list[list[float]]]:
    """One logistic regression per class on ``features``; returns classes and weight rows.

    For class *i* its own rows weigh ``n / (k·n_i)`` and all others 1; the loss is their
    weighted sum with ``1/(2c)·|w|²``.  Two classes need one fit, weighted on both sides.  A fit
    ends when its gradient is ``tol`` times the first one or shorter.

    Every iteration is one pass over the rows for all classes (:mod:`logistic`), which are therefore
    written once and kept in the executors' memory as far as it goes.  ``partitions`` deals the rows
    out anew before that; ``width`` saves a job to learn it.
    """
    sizes = {r[column]: r["n"] for r in df.groupBy(column).agg(F.count("*").alias("n")).collect()}
    classes, n = tuple(sorted(sizes)), sum(sizes.values())
    if len(classes) < 2:
        raise ValueError(f"training needs at least two classes, found {list(classes)}")
    balanced = [n / (len(sizes) * sizes[k]) for k in classes]
    fitted = classes[1:] if len(classes) == 2 else classes
    costs = np.array([
        [balanced[j] if k == label else -(balanced[j] if len(classes) == 2 else 1.0) for j, label in enumerate(classes)]
        for k in fitted
    ])
    rows = df.select("features", column)
    width = width or rows.first()["features"].size
    blocks = stage(sparse_blocks(rows.repartition(partitions) if partitions else rows, "features", column))
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights = minimise(blocks, width, costs, classes, 1.0 / c, tol, max_iter).tolist()
    finally:
        blocks.unpersist()
    return classes, [[-w for w in weights[0]], weights[0]] if len(classes) == 2 else weights


def class_scores(weighed: Column, model: TextModel) -> Column:
    """Array of decision values, in class order, from a struct ``indices, weights``."""

    def score(coef: Sequence[float], intercept: float) -> Column:
        weights = literal_doubles(coef)
        terms = F.zip_with(
            weighed["indices"], weighed["weights"], lambda i, w: w * F.element_at(weights, i + 1)
        )
        return F.lit(float(intercept)) + F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)

    return F.array(*(score(w, b) for w, b in zip(model.coef, model.intercept, strict=True)))


def best_class(scores: Column, classes: Sequence[int]) -> Column:
    """Class of the highest score, the first of equal ones."""
    codes = F.array(*map(F.lit, classes))
    return F.element_at(codes, F.array_position(scores, F.array_max(scores)).cast("int"))


def predict(df: DataFrame, model: TextModel, column: str = "processed") -> DataFrame:
    """Add ``nnz`` (known terms), ``scores``, ``prediction`` and ``label`` to cleaned texts.

    No shuffle and no Python: counting, weighting and scoring happen on the row, once.
    """

    def outcome(counts: Column, scores: Column) -> Column:
        best = best_class(scores, model.classes)
        return let(
            best,
            lambda code: F.struct(
                F.size(counts["indices"]).cast("bigint").alias("nnz"),
                scores.alias("scores"),
                code.alias("prediction"),
                lb.label_name(code).alias("label"),
            ),
        )

    result = let(
        F.unwrap_udt("term_counts"),
        lambda counts: let(
            row_weights(counts, model.idf),
            lambda weighed: let(
                class_scores(weighed, model), lambda scores: outcome(counts, scores)
            ),
        ),
    )
    return with_fields(count_terms(df, model.terms, column), result, "term_counts")


def predict_long(
    df: DataFrame,
    vocab: DataFrame,
    coefficients: DataFrame,
    intercepts: dict[int, float],
    key: str = "id",
    column: str = "processed",
) -> DataFrame:
    """The same prediction by joins, for vocabularies beyond the row form.

    ``vocab (term, idf)`` and ``coefficients (class, term, coef)`` stay tables, joined by term
    and broadcast by Spark only if small.  ``key`` must be unique.  Returns ``key, nnz, scores,
    prediction, label``.
    """
    classes = sorted(intercepts)
    wide = coefficients.groupBy("term").agg(
        *(F.sum(F.when(F.col("class") == c, F.col("coef"))).alias(f"_w{c}") for c in classes)
    )
    known = vocab.select("term", "idf").join(wide, "term", "left")
    # Read for the terms and for the rows without any; cleaned once.
    texts = stage(df.select(key, column))
    raw = term_freq(texts, key, column).join(known, "term").withColumn("w", F.col("tf") * F.col("idf"))
    sums = raw.groupBy(key).agg(
        F.count("w").alias("nnz"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"),
        *(F.sum(F.col("w") * F.col(f"_w{c}")).alias(f"_s{c}") for c in classes),
    )
    # Sums are combined before they move; rows without a known term keep their intercepts.
    summed = texts.select(key).join(sums, key, "left").fillna(0, ["nnz"])
    scores = F.array(
        *(
            F.lit(float(intercepts[c])) + F.coalesce(F.col(f"_s{c}") / F.col("_norm"), F.lit(0.0))
            for c in classes
        )
    )
    return summed.select(key, "nnz", scores.alias("scores")).select(
        "*", best_class(F.col("scores"), classes).alias("prediction")
    ).withColumn("label", lb.label_name("prediction"))

