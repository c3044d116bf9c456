"""The training job: corpus to evaluated model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelscope.functions import script
from fidelscope.functions.once import with_computed
from fidelscope.functions.text import clean_text
from fidelscope.operators.corpus import (
    check_labels,
    coerce_labels,
    corpus_stats,
    label_distribution,
    stratified_split,
)
from fidelscope.operators.features import fit_vocabulary
from fidelscope.operators.linear import TOLERANCE, feature_vectors, fit_ovr, predict
from fidelscope.operators.metrics import accuracy, classification_report, confusion_matrix
from fidelscope.operators.model import TextModel
from fidelscope.operators.sentences import non_blank
from fidelscope.session import stage
from fidelscope.sources.models import save_model


@dataclass(frozen=True)
class TrainingConfig:
    test_share: float = script.TEST_SHARE
    seed: int = script.SEED
    min_df: int = script.MIN_DF
    max_df: float = script.MAX_DF
    max_features: int = script.MAX_FEATURES
    max_iter: int = script.MAX_ITER
    tol: float = TOLERANCE
    profile: str = "ethiopic"
    #: Partitions of the training rows; those that the corpus has if not given (see ``fit_ovr``).
    partitions: int | None = None


@dataclass(frozen=True)
class TrainingResult:
    """The model and the predictions on the test part, with their evaluation.

    ``split`` holds the coded rows and their part, ``labels`` counts the raw labels, ``stats`` the
    texts before and after cleaning.
    """

    model: TextModel
    split: DataFrame
    predictions: DataFrame
    labels: DataFrame
    stats: DataFrame

    def accuracy(self) -> DataFrame:
        return accuracy(self.predictions)

    def report(self) -> DataFrame:
        return classification_report(self.predictions)

    def confusion(self) -> DataFrame:
        return confusion_matrix(self.predictions)


def clean_corpus(corpus: DataFrame, cfg: TrainingConfig = TrainingConfig()) -> DataFrame:
    cleaned = with_computed(corpus, processed=clean_text("text", profile=cfg.profile))
    return cleaned.select("id", "label", "processed")


def prepare_corpus(corpus: DataFrame, cfg: TrainingConfig = TrainingConfig()) -> DataFrame:
    """Clean and drop blank texts; labels of blank texts do not matter after that."""
    return non_blank(clean_corpus(corpus, cfg))


def fit_model(train_part: DataFrame, cfg: TrainingConfig = TrainingConfig()) -> TextModel:
    """Vocabulary, idf and classifier from the training part (``processed, label``)."""
    vocab = fit_vocabulary(
        train_part, min_df=cfg.min_df, max_df=cfg.max_df, max_features=cfg.max_features
    )
    words = sorted(vocab.select("idx", "term", "idf").collect())  # at most max_features rows
    if not words:
        raise ValueError("no term occurs often enough; the vocabulary is empty")
    terms, idf = [w["term"] for w in words], [w["idf"] for w in words]
    vectors = feature_vectors(train_part, terms, idf)
    classes, weights = fit_ovr(
        vectors, max_iter=cfg.max_iter, tol=cfg.tol, width=len(terms) + 1,
        partitions=cfg.partitions,
    )
    return TextModel(
        classes,
        tuple(terms),
        tuple(idf),
        tuple(tuple(w[:-1]) for w in weights),
        tuple(w[-1] for w in weights),
    )


def train(
    corpus: DataFrame, cfg: TrainingConfig = TrainingConfig(), path: str | None = None
) -> TrainingResult:
    """The whole job on ``corpus (id, text, label)``.

    The cleaned corpus is materialised once; everything after reads it.  The driver sees the
    vocabulary, the weights and a few counts.  With ``path`` the model is saved there.
    """
    every = stage(clean_corpus(corpus, cfg))
    cleaned = non_blank(every)
    if cleaned.isEmpty():
        raise ValueError("no usable text remains after cleaning")
    coded = coerce_labels(cleaned)
    check_labels(coded)
    split = stage(stratified_split(coded, cfg.test_share, cfg.seed))
    model = fit_model(split.where(F.col("part") == "train"), cfg)
    if path:
        save_model(corpus.sparkSession, model, path)
    tested = predict(split.where(F.col("part") == "test").withColumnRenamed("label", "truth"), model)
    return TrainingResult(
        model,
        split,
        tested.select("id", F.col("truth").alias("label"), "prediction"),
        label_distribution(every),
        corpus_stats(every),
    )
