"""The trained text model as plain values, and its tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY_SCHEMA = "idx BIGINT, term STRING, idf DOUBLE"
COEFFICIENT_SCHEMA = "class INT, idx BIGINT, coef DOUBLE"
INTERCEPT = -1  # idx of the intercept in the coefficient table


@dataclass(frozen=True)
class TextModel:
    """Vocabulary, idf and one coefficient row per class.

    Held by the driver and sent to tasks; its size is bounded by the vocabulary limit of the
    training (10,000 terms by default) times the number of classes.
    """

    classes: tuple[int, ...]
    terms: tuple[str, ...]
    idf: tuple[float, ...]
    coef: tuple[tuple[float, ...], ...]
    intercept: tuple[float, ...]

    @classmethod
    def from_tables(cls, vocab: DataFrame, coefficients: DataFrame) -> TextModel:
        """Build from ``vocab (idx, term, idf)`` and ``coefficients (class, idx, coef)``."""
        words = sorted(vocab.select("idx", "term", "idf").collect())
        rows: dict[int, dict[int, float]] = {}
        for r in coefficients.select("class", "idx", "coef").collect():
            rows.setdefault(r["class"], {})[r["idx"]] = r["coef"]
        classes = tuple(sorted(rows))
        return cls(
            classes,
            tuple(w["term"] for w in words),
            tuple(w["idf"] for w in words),
            tuple(tuple(rows[c].get(w["idx"], 0.0) for w in words) for c in classes),
            tuple(rows[c].get(INTERCEPT, 0.0) for c in classes),
        )

    def vocabulary_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, w) for i, (t, w) in enumerate(zip(self.terms, self.idf, strict=True))]
        return spark.createDataFrame(rows, VOCABULARY_SCHEMA)

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c, i, v)
            for c, coef, b in zip(self.classes, self.coef, self.intercept, strict=True)
            for i, v in [(INTERCEPT, b), *enumerate(coef)]
        ]
        return spark.createDataFrame(rows, COEFFICIENT_SCHEMA)

    def named_coefficients(self, spark: SparkSession) -> DataFrame:
        """``class, term, coef`` without intercepts, for joins on the term."""
        table, words = self.coefficient_table(spark), self.vocabulary_table(spark)
        return table.join(words, "idx").select("class", "term", F.col("coef"))
