"""Model store: versions of a vocabulary table and a coefficient table, committed as one.

A version is a folder of its own.  It counts once a row of the ``commits`` table names it, which is
the last thing written and appears as a whole or not at all.  So a reader finds either the earlier
model or the new one, never parts of both, and a write that fails changes nothing.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from fidelscope.operators.model import COEFFICIENT_SCHEMA, VOCABULARY_SCHEMA, TextModel

COMMIT_SCHEMA = "number BIGINT, version STRING"


def _commits(spark: SparkSession, path: str) -> list:
    """All commits, the latest last; none where there is no store.  One row per saved model."""
    try:
        return sorted(tuple(r) for r in spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/commits").collect())
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise


def save_model(spark: SparkSession, model: TextModel, path: str) -> str:
    """Write the model as the newest version under ``path``; returns the version's name.

    Of two writers at the same time one comes last, and readers get that one's model whole.
    """
    version = f"version-{uuid4().hex}"
    model.vocabulary_table(spark).coalesce(1).write.parquet(f"{path}/{version}/vocabulary")
    model.coefficient_table(spark).coalesce(1).write.parquet(f"{path}/{version}/coefficients")
    number = max((n for n, _ in _commits(spark, path)), default=0) + 1
    spark.createDataFrame([(number, version)], COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(
        f"{path}/commits"
    )
    return version


def model_tables(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and coefficients of the newest version, or of an earlier one by its name."""
    known = [v for _, v in _commits(spark, path)]
    if not known or (version and version not in known):
        raise FileNotFoundError(f"no model {version or ''} at {path}")
    folder = f"{path}/{version or known[-1]}"
    return (
        spark.read.schema(VOCABULARY_SCHEMA).parquet(f"{folder}/vocabulary"),
        spark.read.schema(COEFFICIENT_SCHEMA).parquet(f"{folder}/coefficients"),
    )


def load_model(spark: SparkSession, path: str, version: str | None = None) -> TextModel:
    """Read a stored model; a missing or incomplete one is an error."""
    try:
        model = TextModel.from_tables(*model_tables(spark, path, version))
    except AnalysisException as error:
        raise FileNotFoundError(f"no model at {path}") from error
    if not model.terms or not model.classes:
        raise FileNotFoundError(f"the model at {path} is empty")
    return model
