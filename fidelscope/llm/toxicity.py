"""Toxicity by a support vector machine over a string-subsequence kernel (operator 6).

Two words are alike by the subsequences of three characters they share, each weighted down by
the characters it skips; so inserted or missing characters cost little.  The kernel of a word
with a few hundred landmark words gives its Nyström features.  A sentence is as toxic as its
worst word, a document as its three worst words, wherever they stand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelscope.llm.common import fold, map_texts, slices
from fidelscope.session import stage

#: Subsequences may skip characters within this many; every skipped one costs this factor.
WINDOW, DECAY = 5, 0.6
SPAN = np.array([(a, b) for a, b in combinations(range(1, WINDOW), 2)])
WEIGHT = DECAY ** (SPAN[:, 1] - 2.0)
#: The kernel is this power of the normalised subsequence kernel: only near words count.
POWER = 4
#: A word is far, and has no kernel, if its features, each times its largest value in any toxic
#: landmark, add up to less than NEAR: no such landmark's unraised kernel can then be as large.
NEAR = 0.55
#: A word is a toxic landmark from this log-likelihood ratio of its documents on.
EVIDENCE = 7.0
#: A document is judged by the margins of so many worst words.
WORST = 3
#: Bounds of the fit: sampled documents per class, training words, landmarks of each kind.
DOCS_PER_CLASS, TRAINING_WORDS, TOXIC_LANDMARKS, CLEAN_LANDMARKS = 6_000, 30_000, 200, 200
CACHE_WORDS = 600_000
#: Calibration when nothing was learned: whatever the margins, a score below 1e-4.
CLEAN = np.r_[np.zeros(WORST), -10.0]
SENTENCE_END = r"[.!?\n]+"
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
COMMON_EDGE = ".,;:!?\"'()#*$%&|"
INNER = re.compile(r"[\W_]+")
#: Digits and signs that stand for a letter inside a word.
LOOKALIKES = str.maketrans("01345@$", "oieasas")
SPELLED = re.compile(r"(?<!\S)\w(?: \w){2,}(?!\S)")
SCHEMA = "doc_id BIGINT, score DOUBLE, worst_word STRING"


def plain(word: str) -> str:
    """A word in lower case without edge or inner signs, look-alikes inside turned to letters."""
    word = word.lower().strip(COMMON_EDGE)
    if word.isalpha():
        return word
    return INNER.sub("", EDGE.sub("", word).translate(LOOKALIKES))


def words_of(text: str) -> list[str]:
    return text.split() + [m.replace(" ", "") for m in SPELLED.findall(text)]


def encode(words: list[str]) -> np.ndarray:
    """Characters as numbers below 64, a mark at both ends, zeros behind; a row for each word."""
    longest = max(map(len, words)) + 2
    rows = np.zeros((len(words), longest + WINDOW), np.int32)
    joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    lengths = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(joined)) - np.repeat(ends - lengths, lengths) + 1
    rows[row, place] = 3 + joined % 61
    rows[:, 0] = 1
    rows[np.arange(len(words)), lengths + 1] = 2
    return rows


def reach(words: list[str], largest: np.ndarray) -> np.ndarray:
    """At least what each word's features times ``largest`` of their subsequence add up to.

    Equal subsequences of a word are not added up before its length is taken, which can only make
    the length too small; so nothing has to be sorted.
    """
    codes = encode(words)
    width = codes.shape[1] - WINDOW
    total, square = np.zeros(len(words)), np.zeros(len(words))
    for (b, c), weight in zip(SPAN, WEIGHT, strict=True):
        first, second, third = codes[:, :width], codes[:, b : b + width], codes[:, c : c + width]
        there = third > 0
        total += weight * (largest[first << 12 | second << 6 | third] * there).sum(axis=1)
        square += weight**2 * there.sum(axis=1)
    return total / np.sqrt(square)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, subsequence and value of all non-zero features, each word of length 1."""
    codes = encode(words)
    width = codes.shape[1] - WINDOW
    first = codes[:, :width, None]
    second = codes[:, np.arange(width)[:, None] + SPAN[:, 0]]
    third = codes[:, np.arange(width)[:, None] + SPAN[:, 1]]
    key = (first << 12 | second << 6 | third).astype(np.int64)
    key |= np.arange(len(words), dtype=np.int64)[:, None, None] << 18
    there = (first > 0) & (second > 0) & (third > 0)
    keys, values = key[there], np.broadcast_to(WEIGHT, key.shape)[there]
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    sums = np.add.reduceat(values, starts) if len(keys) else values
    row, feature = keys[starts] >> 18, keys[starts] & 0x3FFFF
    norm = np.sqrt(np.bincount(row, sums * sums, len(words)))
    return row, feature, sums / norm[row]


@dataclass
class ToxicityModel:
    """Landmark words, the weights of their kernels, and the calibration of the worst word."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    n_toxic: int = 0
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(WORST + 1))
    #: Words judged so far, and the margins of those above the bias.
    seen: set[str] = field(default_factory=set, repr=False)
    older: set[str] = field(default_factory=set, repr=False)
    bad: dict[str, float] = field(default_factory=dict, repr=False)
    tables: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "seen": set(), "older": set(), "bad": {}, "tables": None}

    def kernels(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of words that are near any landmark, and their kernels with all landmarks."""
        if self.tables is None:
            row, feature, value = features(self.landmarks)
            order = np.argsort(feature, kind="stable")
            feature, holder, held = feature[order], row[order], value[order].astype(np.float32)
            used, begin, holders = np.unique(feature, return_index=True, return_counts=True)
            slot = np.zeros(1 << 18, np.int32)
            slot[used] = np.arange(1, len(used) + 1)
            bound = np.zeros(len(used) + 1, np.float32)
            toxic = holder < self.n_toxic
            np.maximum.at(bound, slot[feature[toxic]], held[toxic])
            # No landmark holds the subsequences of slot 0.
            self.tables = slot, np.append(0, begin), np.append(0, holders), holder, held, bound, bound[slot]
        slot, begin, holders, holder, held, bound, largest = self.tables
        # A little less than NEAR, for rounding.
        near = np.flatnonzero(reach(words, largest) >= NEAR - 1e-4)
        found = np.zeros((len(near), len(self.landmarks)), np.float32)
        if len(near):
            row, feature, value = features([words[i] for i in near])
            at = slot[feature]
            far = np.bincount(row, value * bound[at], len(near)) < NEAR
            near, found = near[~far], found[: len(near) - far.sum()]
            # Only landmarks that hold a subsequence are added up, in the order of subsequences.
            some = ~far[row] & (at > 0)
            row, value, at = (np.cumsum(~far) - 1)[row[some]], value[some].astype(np.float32), at[some]
            starts = np.searchsorted(row, np.arange(0, len(near) + 256, 256))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                n = holders[at[a:b]]
                place = np.repeat(begin[at[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cell = np.repeat(row[a:b] * found.shape[1], n) + holder[place]
                np.add.at(found.reshape(-1), cell, held[place] * np.repeat(value[a:b], n))
        np.power(found, POWER, out=found, where=found > 0)
        return near, found

    def margins(self, words: list[str]) -> np.ndarray:
        """Signed distance of each plain word from the separating plane."""
        out = np.full(len(words), self.bias)
        if self.landmarks:
            for part in self.parts(words):
                near, kernel = self.kernels([words[i] for i in part])
                out[part[near]] += kernel @ self.weights
        return out

    @staticmethod
    def parts(words: list[str]):
        """Places of words of like length, at most about 260,000 subsequences at a time."""
        lengths = np.array([len(w) for w in words], np.int64) + 2
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 2]
        sizes = lengths[order] * len(WEIGHT)
        a = 0
        while a < len(order):
            b = a + max(1, (1 << 18) // int(sizes[a]))
            b = min(b, a + max(1, (1 << 18) // int(sizes[min(b, len(order)) - 1])), len(order))
            yield order[a:b]
            a = b

    def worst(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        """The largest margins of each text's words, repeated ones counted, and the worst word."""
        per_text = [words_of(text) if text else [] for text in texts]
        present = set().union(*per_text)
        missing = present - self.seen
        if len(self.seen) + len(missing) > CACHE_WORDS // 2:
            # Words used lately stay; margins are kept for all words that may still be known.
            self.older, self.seen = self.seen, set()
            missing = present
            known = self.older | present
            self.bad = {w: m for w, m in self.bad.items() if w in known}
        again = missing & self.older
        self.seen |= again
        missing = list(missing - again)
        forms = [plain(w) for w in missing]
        distinct = sorted(set(forms))
        margins = self.margins(distinct)
        found = {distinct[i]: float(margins[i]) for i in np.flatnonzero(margins > self.bias)}
        self.bad.update((w, found[f]) for w, f in zip(missing, forms, strict=True) if f in found)
        self.seen.update(missing)
        out, worst = np.full((len(texts), WORST), self.bias), []
        for i, words in enumerate(per_text):
            ranked = sorted((-self.bad[w], w) for w in self.bad.keys() & set(words))[:WORST]
            values = [-m for m, w in ranked for _ in range(min(words.count(w), WORST))][:WORST]
            out[i, : len(values)] = values
            worst.append(ranked[0][1] if ranked else None)
        return out, worst

    def probability(self, margins: np.ndarray) -> np.ndarray:
        x = np.c_[margins, np.ones(len(margins))]
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.calibration, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from labelled documents outside the held-out quarter.

    ``docs`` needs ``doc_id`` and ``text`` and must be a scan; other columns are ignored.  At most 6,000
    labelled rows per class are sampled, by a hash of the row's place; their sentences carry the document's label and are counted by word in Spark.  At most 30,000 words of a kind
    come to the driver: those in significantly many toxic documents, of which the 200 most
    frequent are landmarks, and then the words near to those, which the machine has to tell apart (squared hinge, Newton steps); the
    200 most frequent clean ones of them are landmarks too.  The worst margins of the sampled
    documents calibrate the score.

    With no such labelled row, labels of one class only, or no landmark, nothing tells documents
    apart, and every document has a score near 0: a filter then keeps all rows.
    """
    marks = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(
        fold(F.col("doc_id"), 4) != 2
    )
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    labelled = stage(
        numbered.where("text IS NOT NULL").select("doc_id", "row").join(marks, "doc_id")
        .select("row", "toxic", F.xxhash64("row").alias("place"))
    )
    chosen = [
        labelled.where(condition).orderBy("place", "row").limit(DOCS_PER_CLASS).select("row", "toxic")
        for condition in ("toxic = 1", "toxic <> 1")
    ]
    # Rows, not ids, are limited: twice the bound at most, however often an id repeats.
    picked = stage(chosen[0].union(chosen[1]))
    sample = stage(numbered.join(F.broadcast(picked), "row").select("row", "toxic", "text"))
    sentence = F.explode(F.split("text", SENTENCE_END)).alias("sentence")
    word = F.explode(F.array_distinct(F.split(F.lower("sentence"), r"[\x20\x09-\x0D]+"))).alias("word")
    bad = F.col("toxic") == 1
    counts = stage(
        sample.withColumnRenamed("row", "doc").select("toxic", "doc", sentence).select("toxic", "doc", word).where("word <> ''")
        .groupBy("doc", "toxic", "word").agg(F.count("*").alias("n")).groupBy("word").agg(*(
            F.sum(F.when(which, n).otherwise(0)).alias(name) for name, which, n in (
                ("bad", bad, F.col("n")), ("good", ~bad, F.col("n")),
                ("bad_docs", bad, F.lit(1)), ("good_docs", ~bad, F.lit(1)))
        ))
    )
    share = sample.agg(F.avg(bad.cast("double"))).first()[0] or 0.0
    both = F.col("bad_docs") + F.col("good_docs")
    clean_part = F.col("good_docs") * F.log(F.col("good_docs") / (both * F.lit(1 - share)))
    evidence = F.col("bad_docs") * F.log(F.col("bad_docs") / (both * F.lit(share))) + F.when(
        F.col("good_docs") > 0, clean_part).otherwise(0)
    typical = counts.where(F.col("bad_docs") > both * max(share, 0.5)).withColumn("evidence", evidence).where(
        F.col("evidence") >= EVIDENCE).orderBy(F.desc("evidence"), "word").limit(TRAINING_WORDS)
    toxic = by_form(typical)
    toxic = sorted(toxic, key=lambda w: (-toxic[w][0], w))
    toxic = toxic[:TOXIC_LANDMARKS]
    model = ToxicityModel(toxic, np.zeros(0), -1.0, len(toxic))
    if toxic:
        near = counts.select("word", "bad", "good").mapInArrow(near_words(docs, model), "word STRING, bad BIGINT, good BIGINT")
        merged = by_form(near.orderBy(F.desc(F.col("bad") + F.col("good")), "word").limit(TRAINING_WORDS))
        model = train(model.landmarks, sorted(merged.items()))
    margins = map_texts(sample.select("toxic", "text"), margin_reader(docs, model), "toxic INT, margins ARRAY<DOUBLE>")
    model.calibration = calibrate(margins.collect()) if model.landmarks else CLEAN
    return model


def by_form(counted: DataFrame) -> dict[str, np.ndarray]:
    """Sentence counts of a bounded word table, added up by plain form."""
    merged: dict[str, np.ndarray] = {}
    for row in counted.collect():
        if form := plain(row["word"]):
            merged[form] = merged.get(form, 0) + np.array([row["bad"], row["good"]], np.float64)
    return merged


def near_words(docs: DataFrame, model: ToxicityModel):
    """Keep the counted words that are near a toxic landmark: what the machine must tell apart."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        model = shared.value
        for batch in batches:
            forms = [plain(w) for w in batch.column("word").to_pylist()]
            mask = np.zeros(len(forms), bool)
            for part in model.parts(forms):
                near, kernel = model.kernels([forms[i] for i in part])
                mask[part[near]] = kernel.max(axis=1) > 0.05
            yield batch.filter(pa.array(mask))

    return keep


def train(toxic: list[str], counted: list[tuple[str, np.ndarray]]) -> ToxicityModel:
    """Squared-hinge SVM on Nyström features of words weighted by their sentences."""
    names = [name for name, _ in counted]
    bad, good = np.array([n for _, n in counted]).T
    clean = [names[i] for i in np.argsort(-good, kind="stable") if good[i] > bad[i]][:CLEAN_LANDMARKS]
    landmarks = toxic + [w for w in clean if w not in set(toxic)]
    model = ToxicityModel(landmarks, np.zeros(len(landmarks)), 0.0, len(toxic))
    among = kernel_matrix(model, landmarks)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3))
    # The last word's kernel is nothing: it stands for all far words, so that the bias is clean.
    x = np.zeros((len(names) + 1, len(landmarks) + 1))
    x[:, -1] = 1.0
    parts = [slice(a, min(a + 2_000, len(names))) for a in range(0, len(names), 2_000)]
    for part in parts:
        x[part, :-1] = kernel_matrix(model, names[part]) @ root
    toxic_weight, clean_weight = np.r_[np.log1p(bad), 0.0], np.log1p(good)
    clean_weight = np.r_[clean_weight, toxic_weight.sum() + clean_weight.sum()]
    parts.append(slice(len(names), len(x)))
    w = np.zeros(x.shape[1])
    ridge = 0.05 * np.eye(len(w))
    for _ in range(30):
        # Every word is a toxic and a clean row, but lies here once, and no step copies them all.
        score = x @ w
        up, down = toxic_weight * (score < 1), clean_weight * (-score < 1)
        curve = sum((x[part].T * (up + down)[part]) @ x[part] for part in parts)
        new = np.linalg.solve(curve + ridge, x.T @ (up - down))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    model.weights, model.bias = root @ w[:-1], float(w[-1])
    return model


def kernel_matrix(model: ToxicityModel, words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), len(model.landmarks)))
    for a in range(0, len(words), 500):
        near, kernel = model.kernels(words[a : a + 500])
        out[a + near] = kernel
    return out


def calibrate(rows: list) -> np.ndarray:
    """Logistic regression of the label on the worst margins, by Newton steps; clean without both labels."""
    y = np.array([r["toxic"] == 1 for r in rows], float)
    if len(set(y.tolist())) < 2:
        return CLEAN
    w = np.zeros(WORST + 1)
    x = np.c_[np.array([r["margins"] for r in rows]), np.ones(len(rows))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(curve, x.T @ (p - y) + 0.05 * w)
    return w


def margin_reader(docs: DataFrame, model: ToxicityModel):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches):
        for batch, _ in slices(batches, "text", 2 << 20):
            margins, _ = shared.value.worst(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").cast(pa.int32()), pa.array(margins.tolist(), pa.list_(pa.float64()))],
                ["toxic", "margins"],
            )

    return read


def scorer(docs: DataFrame, model: ToxicityModel):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch, _ in slices(batches, "text", 2 << 20):
            margins, words = shared.value.worst(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(shared.value.probability(margins)),
                 pa.array(words, pa.string())], ["doc_id", "score", "worst_word"],
            )

    return score


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, worst_word`` for every row, from its whole text alone.

    A null or empty text, or one without a letter, has the score of a text without any toxic
    word.  Repeated rows are scored one by one.
    """
    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), scorer(docs, model), SCHEMA)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with all their columns.

    Rows with a null or empty text stay (unless the threshold is below the score of a text without toxic words); of
    repeated rows all stay or none; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch, _ in slices(batches, "text", 2 << 20):
            margins, _ = shared.value.worst(batch.column("text").to_pylist())
            yield batch.filter(pa.array(shared.value.probability(margins) < threshold))

    return map_texts(docs, keep, docs.schema)
