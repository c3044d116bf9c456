"""TF-IDF features: token counts, document frequencies, vocabulary, weighted rows.

Two forms of the same features:

* *row form* – counts and weights of a row as arrays beside the row.  A row is weighted where
  it lies, without a shuffle; every task holds the vocabulary, so it is for bounded ones.
* *long form* – one line per row and term, joined to the vocabulary.  Works for vocabularies
  of any size, which Spark broadcasts or shuffles by their actual size.

The caller chooses the form; nothing switches by size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelscope.functions import script
from fidelscope.functions.once import let, with_fields
from fidelscope.functions.text import feature_tokens


def counted_terms(column: str) -> Column:
    """The terms of a cleaned text and their counts: ``ARRAY<STRUCT<term, tf>>``, in term order.

    Sorted tokens lie in runs; a run's length is the distance from its start to the next one's.
    """

    def run_starts(words: Column) -> Column:
        # Before the first word lies null.
        return F.array_compact(F.transform(words, lambda w, i: F.when(~w.eqNullSafe(F.get(words, i - 1)), i + 1)))

    def runs(words: Column, starts: Column) -> Column:
        after = lambda j: F.coalesce(F.get(starts, j + 1), F.size(words) + 1)
        return F.transform(
            starts,
            lambda i, j: F.struct(F.get(words, i - 1).alias("term"), (after(j) - i).cast("bigint").alias("tf")),
        )

    words = F.sort_array(F.coalesce(feature_tokens(column), F.array().cast("array<string>")))
    return let(words, lambda w: let(run_starts(w), lambda starts: runs(w, starts)))


def term_freq(df: DataFrame, key: str = "id", column: str = "processed") -> DataFrame:
    """Long-form counts ``key, term, tf``, counted within the row: nothing is shuffled.

    ``key`` must be unique.
    """
    return df.select(key, F.inline(counted_terms(column)))


def term_stats(df: DataFrame, column: str = "processed") -> DataFrame:
    """``term, df, cf``: texts that hold the term, and its occurrences, in one pass.

    Each text emits its distinct tokens and, behind them, its tokens; both are combined before the
    only shuffle, which therefore carries terms, not texts.
    """
    texts = df.select(feature_tokens(column).alias("words")).select("words", F.array_distinct("words").alias("once"))
    every = texts.select(F.size("once").alias("n"), F.posexplode(F.concat("once", "words")).alias("place", "term"))
    return every.groupBy("term").agg(
        F.count_if(F.col("place") < F.col("n")).alias("df"), F.count_if(F.col("place") >= F.col("n")).alias("cf")
    )


def corpus_size(df: DataFrame) -> Column:
    """Number of texts as a scalar subquery."""
    return df.agg(F.count("*").alias("n")).scalar()


def doc_freq(
    df: DataFrame,
    column: str = "processed",
    min_df: int = script.MIN_DF,
    max_df: float = script.MAX_DF,
) -> DataFrame:
    """Terms in at least ``min_df`` texts and at most the share ``max_df`` of all texts."""
    return term_stats(df, column).where(
        (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * corpus_size(df))
    )


def vocabulary(terms: DataFrame, max_features: int = script.MAX_FEATURES) -> DataFrame:
    """The ``max_features`` most frequent terms, ties by term; ``idx`` numbers them by term."""
    top = terms.orderBy(F.desc("cf"), "term").limit(max_features)
    # At most max_features rows are numbered, so the single partition is bounded.
    return top.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("bigint"))


def idf(df: Column | str, n: Column | int) -> Column:
    """Smoothed inverse document frequency ``ln((1 + n) / (1 + df)) + 1``."""
    count = F.col(df) if isinstance(df, str) else df
    size = F.lit(n) if isinstance(n, int) else n
    return F.log((1 + size) / (1 + count)) + 1


def fit_vocabulary(
    df: DataFrame,
    column: str = "processed",
    min_df: int = script.MIN_DF,
    max_df: float = script.MAX_DF,
    max_features: int = script.MAX_FEATURES,
) -> DataFrame:
    """``idx, term, df, cf, idf`` fitted on the texts given (the training part only)."""
    kept = vocabulary(doc_freq(df, column, min_df, max_df), max_features)
    return kept.withColumn("idf", idf("df", corpus_size(df)))


def tfidf(tf: DataFrame, vocab: DataFrame, key: str = "id") -> DataFrame:
    """Long form ``key, term, weight``: tf·idf, L2-normalised per row.

    Terms outside the vocabulary are dropped first; a row without any known term has no line.
    """
    raw = tf.join(vocab.select("term", "idf"), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / norm).alias("weight"))


def literal_doubles(values: Sequence[float]) -> Column:
    """A constant array; folded into one literal by the optimiser."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def literal_strings(values: Sequence[str]) -> Column:
    """A constant array of terms (which never hold a blank)."""
    return F.split(F.lit(" ".join(values)), " ")


def count_terms(df: DataFrame, terms: Sequence[str], column: str = "processed") -> DataFrame:
    """Row form: add ``term_counts`` (a sparse vector over ``terms``)."""
    counter = _term_counter(df.sparkSession.sparkContext.applicationId, tuple(terms))
    return counter.transform(df.withColumn("_tokens", feature_tokens(column))).drop("_tokens")


@lru_cache(maxsize=4)
def _term_counter(application: str, terms: tuple[str, ...]) -> CountVectorizerModel:
    """Handing a vocabulary to the JVM takes seconds, so models in use are kept."""
    return CountVectorizerModel.from_vocabulary(
        list(terms), inputCol="_tokens", outputCol="term_counts"
    )


def row_weights(counts: Column, idf_values: Sequence[float]) -> Column:
    """Struct ``indices, weights`` (tf·idf, L2-normalised) of an unwrapped count vector."""
    idfs = literal_doubles(idf_values)
    raw = F.zip_with(
        counts["indices"], counts["values"], lambda i, tf: tf * F.element_at(idfs, i + 1)
    )

    def norm(weights: Column) -> Column:
        return F.sqrt(F.aggregate(weights, F.lit(0.0), lambda total, w: total + w * w))

    return let(
        raw,
        lambda weights: let(
            norm(weights),
            lambda length: F.struct(
                counts["indices"].alias("indices"),
                F.transform(weights, lambda w: w / length).alias("weights"),
            ),
        ),
    )


def weigh_terms(df: DataFrame, idf_values: Sequence[float]) -> DataFrame:
    """Row form: turn ``term_counts`` into arrays ``indices`` and ``weights``.

    A row without known terms gets empty arrays.
    """
    weighed = let(F.unwrap_udt("term_counts"), lambda counts: row_weights(counts, idf_values))
    return with_fields(df, weighed, "term_counts")
