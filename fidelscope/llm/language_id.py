"""Language identification, word first (operator 7).

A known word is scored by its log frequency in each language.  A word that no language knows is
cut, from the left, into the longest character n-grams that are known, and these are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelscope.llm.common import fold, map_texts, slices, unused
from fidelscope.session import stage

#: A word is a run of letters and combining marks with a letter in it, for the fit and for predictions.
WORD = r"\p{M}*\p{L}[\p{L}\p{M}]*"
WORDS, ASCII_WORDS = regex.compile(WORD), re.compile("[a-z]+")
#: Bounds of the fitted model: rows sampled per language, languages, words, n-grams.  Words and n-grams
#: are taken by their shares within each language, so a small language has as many as a large one.
ROWS_PER_LANGUAGE, MAX_LANGUAGES, MAX_WORDS, MAX_GRAMS = 20_000, 200, 200_000, 200_000
LONGEST_GRAM = 5
CACHE_WORDS = 400_000
UNKNOWN = "und"
SCHEMA = "doc_id BIGINT, lang_pred STRING, score DOUBLE"


def words_of(text: str) -> list[str]:
    text = text.lower()
    return ASCII_WORDS.findall(text) if text.isascii() else WORDS.findall(text)


@dataclass
class LanguageModel:
    """Log frequency of words and n-grams, a row for each and a column for each language."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    cache: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def unseen(self, word: str) -> np.ndarray:
        """Sum over the longest known n-grams, each unknown character skipped."""
        text, at, total = f"<{word}>", 0, np.zeros(len(self.languages))
        while at < len(text):
            for n in range(min(LONGEST_GRAM, len(text) - at), 0, -1):
                row = self.grams.get(text[at : at + n])
                if row is not None:
                    total += self.gram_logs[row]
                    break
            at += n
        return total

    def word_scores(self, word: str) -> np.ndarray:
        row = self.words.get(word)
        if row is not None:
            return self.word_logs[row]
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            found = self.cache[word] = self.unseen(word)
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text)) if text else None
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        weights = np.fromiter(counts.values(), np.float64, len(counts))
        logs = weights @ np.array([self.word_scores(w) for w in counts])
        shares = np.exp(logs - logs.max())
        best = int(np.argmax(logs))
        return self.languages[best], float(shares[best] / shares.sum())


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of the rows outside the held-out quarter.

    At most about 20,000 rows per language are sampled, by a hash of the row's id and place, so that copies
    of a text come and go one by one, for the 200 most frequent languages.  Words and n-grams are
    counted in Spark; the 200,000 of each with the largest shares come to the driver, which bounds the
    model.  What is cut off there is scored by n-grams, or by shorter ones, like any unseen word.
    """
    row = unused(docs, "row")
    rows = docs.withColumn(row, F.monotonically_increasing_id()).where(
        (fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).select("text", "lang", F.xxhash64("doc_id", row).alias("place"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    none = np.zeros((0, len(languages)))
    if not languages:
        return LanguageModel([], {}, none, {}, none)
    share = F.create_map(*(
        F.lit(x) for r in sizes for x in (r["lang"], min(1.0, ROWS_PER_LANGUAGE / r["count"]))))
    sample = rows.where(F.pmod("place", F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")])
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    counts = stage(
        sample.select("lang", words.alias("word")).groupBy("lang", "word").count()
    )
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
    sums = np.array([total.get(name, 0) for name in languages], np.float64)
    by_language = [F.sum(F.when(F.col("lang") == name, F.col("count")).otherwise(0)) for name in languages]
    often = sum((n / F.lit(max(s, 1.0)) for n, s in zip(by_language, sums.tolist(), strict=True)), F.lit(0.0))
    known = stage(
        counts.groupBy("word").agg(F.array(*by_language).alias("counts"), often.alias("often"))
        .orderBy(F.desc("often"), "word").limit(MAX_WORDS).select("word", "counts")
    )
    word_names, word_counts = read_counts(known, "word", len(languages))
    gram_names, gram_counts = read_counts(count_grams(known, len(languages)), "gram", len(languages))
    lengths = np.array([len(g) for g in gram_names], np.int64)
    gram_logs = np.zeros_like(gram_counts)
    for n in range(1, LONGEST_GRAM + 1):
        of = lengths == n
        gram_logs[of] = np.log((gram_counts[of] + 0.5) / (gram_counts[of].sum(axis=0) + 0.5 * max(1, of.sum())))
    return LanguageModel(
        languages, numbered(word_names), np.log((word_counts + 0.5) / (sums + 1.0)), numbered(gram_names), gram_logs
    )


def numbered(names: list[str]) -> dict[str, int]:
    return dict(zip(names, range(len(names)), strict=True))


def read_counts(counted: DataFrame, name: str, languages: int) -> tuple[list[str], np.ndarray]:
    """A bounded table of names and their counts per language."""
    table = counted.select(name, F.col("counts").cast("array<double>")).toArrow()
    flat = table["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table[name].to_pylist(), flat.reshape(-1, languages)


def count_grams(known: DataFrame, languages: int) -> DataFrame:
    """``gram, counts``: the n-grams of most known words.

    A word's own counts are damped by the root, so that frequent words do not drown the rest.
    """
    text = F.concat(F.lit("<"), "word", F.lit(">"))

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*map(of_length, range(1, LONGEST_GRAM + 1))))
    sums = F.array(*(F.sum(F.sqrt(F.col("counts")[i])) for i in range(languages)))
    return (
        known.select("counts", F.explode(grams).alias("gram")).groupBy("gram")
        .agg(sums.alias("counts"), F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(MAX_GRAMS)
    )


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text alone.

    The score is the language's share of the likelihood over all learned languages.  A null text,
    one without a letter, and any text when nothing was learned, is ``und`` with score 0.  Ties
    go to the language that comes first in the alphabet.  Repeated rows are predicted one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        model = shared.value
        for batch, _ in slices(batches, "text", 4 << 20):
            found = [model.predict(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()),
                 pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"],
            )

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), label, SCHEMA)
