"""Classification of the sentences of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelscope.operators.linear import predict
from fidelscope.operators.model import TextModel
from fidelscope.operators.sentences import prepare_sentences
from fidelscope.session import stage


def score_sentences(texts: DataFrame, model: TextModel, column: str = "text", **cleaning):
    """Sentences of ``texts`` with ``nnz, prediction, label``; other columns are carried along.

    A narrow transformation from text to label; also valid on a stream.
    """
    return predict(prepare_sentences(texts, column, **cleaning), model).drop("scores")


def drop_unknown_batches(scored: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Drop batches in which no sentence has a known term; others keep all their sentences.

    The scored rows are written once and read for the decision and for the result, so nothing is
    cleaned or scored twice; a batch of any size keeps to its own partitions.
    """
    scored = stage(scored)
    known = scored.where(F.col("nnz") > 0).select(*batch).distinct()
    return scored.join(known, list(batch), "left_semi")
