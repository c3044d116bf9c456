"""Alignment of two tokenizers' tokens over the same bytes (operator 12).

Side A is a byte-level BPE over a space and the text, side B a piece BPE that puts the space there
itself.  Per batch, an as-of merge finds for each token start the other side's token that covers it; the two
directions together are all overlaps, and overlaps that end together close a group.  Texts are
cut at single spaces between words, where both sides always end a token, so a very long text is aligned
in stretches of bounded size.

Id pairs that end together are counted over the corpus.  Each document then looks up its pairs: the frequent
ones in a table of bounded size that every task holds, the rest by a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelscope.llm.common import map_texts, slices, unused
from fidelscope.llm.tokens import OTHER, Encoder, byte_table, tokenizer_path
from fidelscope.session import stage

#: A space here ends a token on both sides, whatever stands around it.
BORDER = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a stretch of text, and of the stretches aligned at once.
STRETCH, TOGETHER = 1 << 17, 1 << 20
#: Words whose ids are kept.
WORDS_KEPT = 400_000
#: A pair's code is A's id above so many bits of B's id.
B_BITS = 15
#: Pairs that every task holds, the most frequent ones: at most 14 MB.
COMMON = 1 << 20
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Sides:
    """Both tokenizers, and the ids of words met lately."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a = Encoder(path_a)
        self.b = SentencePieceProcessor(model_file=path_b)
        vocabulary = self.a.tokenizer.get_vocab()
        special = self.a.tokenizer.get_added_tokens_decoder()
        table = byte_table()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode() if i in special else bytes(map(table.__getitem__, token))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    @staticmethod
    def words(text: str) -> list[str] | None:
        """Words after a space, ``\\nword`` after a line break; None for a text that goes whole."""
        if OTHER.search(text) or "\n\n\n" in text or "\n\n " in text or text[-1:].isspace():
            return None
        words = text.replace("\n", " \n").split(" ")
        return None if "" in words else words

    def checked(self, ids_a: bytes, ids_b: list[int], raw: bytes) -> tuple[bytes, bytes] | None:
        """Both sides' ids, unless one does not give the bytes back."""
        same_a = b"".join(map(self.bytes_a.__getitem__, np.frombuffer(ids_a, "<u4").tolist())) == raw
        same_b = b"".join(map(self.bytes_b.__getitem__, ids_b)) == raw
        return (ids_a, np.array(ids_b, "<u4").tobytes()) if same_a and same_b else None

    def learn(self, words: list[str]) -> None:
        after = [w for w in words if w[0] == "\n" and len(w) > 1]
        plain = [w for w in words if w[0] != "\n"]
        for some, front, cut in ((plain, " ", 0), (after, "", 1)):
            for at in range(0, len(some), 2_000):
                part = some[at : at + 2_000]
                ids_a = self.a.lines([front + w[cut:] for w in part])
                ids_b = self.b.encode(part, num_threads=1)
                if cut:
                    ids_a = [self.a.newline + a for a in ids_a]
                    # B puts a space before the line break, which belongs to nothing here.
                    ids_b = [b[1:] if b[0] == self.space else b for b in ids_b]
                self.keep(part, ids_a, ids_b, [(front + w).encode() for w in part])
        if "\n" in words:
            self.known["\n"] = self.checked(self.a.newline, self.b.encode("\n")[1:], b"\n")

    def keep(self, words: list[str], ids_a: list[bytes], ids_b: list[list[int]], raw: list[bytes]) -> None:
        """Keep the ids of words, all compared with their bytes at once, or one by one if that fails."""
        flat_a = np.frombuffer(b"".join(ids_a), "<u4")
        flat_b = np.fromiter(chain.from_iterable(ids_b), np.uint32)
        both = ((flat_a, [len(i) // 4 for i in ids_a], self.bytes_a, self.lengths_a),
                (flat_b, [len(i) for i in ids_b], self.bytes_b, self.lengths_b))
        sizes, whole = np.array([len(r) for r in raw]), b"".join(raw)
        same = all(
            b"".join(map(table.__getitem__, flat.tolist())) == whole
            and (np.diff(np.append(0, np.append(0, np.cumsum(lengths[flat]))[np.cumsum(counts)])) == sizes).all()
            for flat, counts, table, lengths in both
        )
        if same:
            packed, ends = flat_b.astype("<u4").tobytes(), (4 * np.cumsum(both[1][1])).tolist()
            starts = [0, *ends[:-1]]
            self.known.update(zip(words, zip(ids_a, [packed[s:e] for s, e in zip(starts, ends, strict=True)], strict=True), strict=True))
        else:
            self.known.update((w, self.checked(a, b, r)) for w, a, b, r in zip(words, ids_a, ids_b, raw, strict=True))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of a space and the text on both sides, None where one loses bytes."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        words = [self.words(t) for t in texts]
        known = self.known
        self.learn(list({w for some in words if some for w in some if w not in known}))
        result = []
        for text, some in zip(texts, words, strict=True):
            if some is None:
                spaced = f" {text}"
                result.append(self.checked(self.a.whole([spaced])[0], self.b.encode(text), spaced.encode()))
                continue
            found = [known[w] for w in some]
            result.append(None if None in found else tuple(b"".join(ids) for ids in zip(*found, strict=True)))
        return result


def stretches(text: str) -> Iterator[str]:
    """A text cut at single spaces between words; the space belongs to neither."""
    at = 0
    while len(text) - at > STRETCH:
        border = BORDER.search(text, at + STRETCH)
        if not border:
            break
        yield text[at : border.start()]
        at = border.end()
    yield text[at:]


def overlaps(lengths_a: np.ndarray, lengths_b: np.ndarray, units_a: np.ndarray, units_b: np.ndarray) -> pd.DataFrame:
    """``a, b, together``: all overlapping tokens by their numbers, and whether both end together.

    ``units`` number the stretch (and so the document) that each token is from; a stretch has the same bytes on
    both sides, so places count on from one to the next and a start names its stretch.
    """
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    left = pd.DataFrame({"start": ends_a - lengths_a, "unit": units_a, "a": np.arange(len(ends_a))})
    right = pd.DataFrame({"start": ends_b - lengths_b, "unit": units_b, "b": np.arange(len(ends_b))})
    # Starts rise over all stretches, so the merge needs no sorting and a match never leaves its stretch.
    covering_b = pd.merge_asof(left, right[["start", "b"]], on="start")
    covering_a = pd.merge_asof(right, left[["start", "a"]], on="start")
    # Equal starts are found from both sides.
    second = covering_a[left["start"].to_numpy()[covering_a["a"]] != covering_a["start"].to_numpy()]
    both = pd.concat([covering_b[["a", "b", "unit"]], second[["a", "b", "unit"]]], ignore_index=True)
    both["together"] = ends_a[both["a"]] == ends_b[both["b"]]
    return both


class Digits:
    """Ids as decimal digits in five bytes, zero bytes in front."""

    def __init__(self, size: int):
        ids = np.arange(size)
        digits = np.stack([ids // 10**k % 10 for k in range(4, -1, -1)], axis=1).astype(np.uint8) + 48
        digits[ids[:, None] < 10 ** np.arange(4, -1, -1)] = 0
        digits[0, 4] = 48
        self.table = digits


class Aligner:
    """Aligns the stretches of many documents at a time and adds up what each document has."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = Sides(path_a, path_b)
        self.digits = Digits(max(len(self.sides.bytes_a), len(self.sides.bytes_b))).table

    def align(self, docs: list, texts: list[str]) -> None:
        found = self.sides.encode(texts)
        for doc, ids in zip(docs, found, strict=True):
            doc.whole &= ids is not None
        units = [(doc, ids) for doc, ids in zip(docs, found, strict=True) if doc.whole]
        if not units:
            return
        sizes = np.array([(len(a) // 4, len(b) // 4) for _, (a, b) in units])
        ids_a, ids_b = (np.frombuffer(b"".join(ids[side] for _, ids in units), "<u4") for side in (0, 1))
        units_a, units_b = (np.repeat(np.arange(len(units)), sizes[:, side]) for side in (0, 1))
        pairs = overlaps(self.sides.lengths_a[ids_a], self.sides.lengths_b[ids_b], units_a, units_b)
        ends = pairs[pairs["together"]]
        # Each A token has at most one B token that ends with it.
        partner = np.full(len(ids_a), -1)
        partner[ends["a"]] = ends["b"]
        last_a = np.flatnonzero(partner >= 0)
        last_b = partner[last_a]
        codes = ids_a[last_a] << B_BITS | ids_b[last_b]
        text, text_ends = self.groups(ids_a, ids_b, last_a, last_b, units_b)
        # A token's number of the last group of each stretch closes it.
        group_ends = np.searchsorted(last_a, np.cumsum(sizes[:, 0]))
        n_pairs = np.bincount(pairs["unit"], minlength=len(units))
        begin = [0, 0]
        for i, (doc, _) in enumerate(units):
            end = [int(group_ends[i]), int(text_ends[i])]
            doc.add(sizes[i], codes[begin[0] : end[0]], text[begin[1] : end[1] - 1], int(n_pairs[i]))
            begin = end

    def groups(self, ids_a, ids_b, last_a, last_b, units_b) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;…;`` of all stretches, and where each ends."""
        before_a, before_b = np.append(0, last_a + 1), np.append(0, last_b + 1)
        group_a = np.searchsorted(last_a, np.arange(len(ids_a)))
        group_b = np.searchsorted(last_b, np.arange(len(ids_b)))
        place_a = np.arange(len(ids_a)) + before_b[group_a]
        place_b = np.arange(len(ids_b)) + before_a[group_b + 1]
        out = np.empty((len(ids_a) + len(ids_b), 6), np.uint8)
        out[place_a, :5], out[place_b, :5] = self.digits[ids_a], self.digits[ids_b]
        out[:, 5] = ord(",")
        out[place_a[last_a], 5], out[place_b[last_b], 5] = ord("|"), ord(";")
        widths = np.cumsum((out != 0).sum(axis=1))
        unit_ends = np.flatnonzero(np.append(units_b[1:] != units_b[:-1], True))
        return out[out != 0].tobytes(), widths[place_b[unit_ends]]


@lru_cache(maxsize=1)
def worker_aligner(path_a: str, path_b: str) -> Aligner:
    """The worker process's own aligner: words met by its earlier tasks are still known."""
    return Aligner(path_a, path_b)


class Document:
    def __init__(self, doc_id: int | None, row: int):
        self.doc_id, self.row, self.whole = doc_id, row, True
        self.n_a = self.n_b = self.n_groups = self.n_overlaps = 0
        self.hash, self.codes = None, []

    def add(self, sizes: np.ndarray, codes: np.ndarray, text: bytes, n_pairs: int) -> None:
        self.n_a += int(sizes[0])
        self.n_b += int(sizes[1])
        self.n_groups += len(codes)
        self.n_overlaps += n_pairs
        if self.hash is None:
            self.hash = sha256()
        else:
            self.hash.update(b";")
        self.hash.update(text)
        unique, times = np.unique(codes, return_counts=True)
        self.codes.append((unique, times.astype(np.uint32)))

    def result(self) -> tuple:
        """Values in the order of ALIGNED."""
        if not self.whole or self.hash is None:
            return self.doc_id, self.row, 0, 0, 0, 0, "", b"", b""
        codes, times = summed(self.codes)
        return (self.doc_id, self.row, self.n_a, self.n_b, self.n_groups, self.n_overlaps, self.hash.hexdigest(),
                codes.astype("<u4").tobytes(), times.astype("<u4").tobytes())


ALIGNED = "doc_id BIGINT, {row} BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_overlaps BIGINT, groups_sha256 STRING, codes BINARY, times BINARY"
TYPES = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sums of their times."""
    if len(parts) == 1:
        return parts[0]
    codes = np.concatenate([c for c, _ in parts])
    unique, place = np.unique(codes, return_inverse=True)
    return unique, np.bincount(place, np.concatenate([t for _, t in parts]), len(unique)).astype(np.int64)


def align(docs: DataFrame, row: str = "row", tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """Per row of ``docs (doc_id, row, text)``: token and group counts, overlaps, digest, linked id pairs.

    ``codes`` are the distinct pairs (A's id above 15 bits of B's id) of tokens that end together, ``times`` how
    often each occurs, both as little-endian unsigned 32-bit numbers.  A null or empty text, or one whose bytes a side
    does not give back, has no tokens: zeros and empty values.  Every row is aligned by itself.
    """
    path_a, path_b = tokenizer_a or tokenizer_path(), tokenizer_b or tokenizer_path("piece_bpe_32k.model")
    names = [c.split()[0] for c in ALIGNED.format(row=row).split(", ")]

    def run(batches):
        aligner = worker_aligner(path_a, path_b)
        for batch, _ in slices(batches, "text", 2 << 20):
            found = [Document(d, r) for d, r in zip(batch.column("doc_id").to_pylist(), batch.column(row).to_pylist(), strict=True)]
            some, texts, size = [], [], 0
            for doc, text in zip(found, batch.column("text"), strict=True):
                for stretch in stretches(text.as_py() or ""):
                    if stretch and doc.whole:
                        some.append(doc)
                        texts.append(stretch)
                        size += len(stretch)
                    if size > TOGETHER:
                        aligner.align(some, texts)
                        some, texts, size = [], [], 0
            aligner.align(some, texts)
            rows = zip(*(doc.result() for doc in found), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, TYPES, strict=True)], names)

    return map_texts(docs.select(F.col("doc_id").cast("long"), row, "text"), run, ALIGNED.format(row=row))


def pair_codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, times, and the place in the batch of the document that each is from."""
    codes, times = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4") for c in ("codes", "times"))
    sizes = np.array([len(x.as_buffer()) // 4 for x in batch.column("codes")], np.int64)
    return codes, times, np.repeat(np.arange(batch.num_rows), sizes)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """``code, n, best``: corpus counts of the pairs, and whether B's id has no more frequent one."""

    def run(batches):
        for batch in batches:
            codes, times, _ = pair_codes(batch)
            unique, sums = summed([(codes, times), (codes[:0], times[:0])])
            yield pa.RecordBatch.from_arrays([pa.array(unique, pa.int64()), pa.array(sums, pa.int64())], ["code", "n"])

    counted = stage(map_texts(aligned.select("codes", "times"), run, "code BIGINT, n BIGINT").groupBy("code").agg(F.sum("n").alias("n")))
    b = F.col("code").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b")
    # One row for each id of side B, so no more than its vocabulary.
    most = counted.groupBy(b).agg(F.max("n").alias("most"))
    return counted.withColumn("b", b).join(F.broadcast(most), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def common_from(pairs: DataFrame, most: int = COMMON) -> int:
    """The smallest power of two such that at most ``most`` pairs occur so often."""
    sizes = {r.power: r.pairs for r in pairs.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(F.count("*").alias("pairs")).collect()}
    power = max(sizes, default=0) + 1
    while power and most >= sizes.get(power - 1, 0):
        power -= 1
        most -= sizes.get(power, 0)
    return 1 << power


def look_up(aligned: DataFrame, pairs: DataFrame, row: str = "row", most: int = COMMON) -> DataFrame:
    """Add ``n_best`` and ``count_sum``: links whose pair is its B id's most frequent, sum of the links' counts."""
    start = common_from(pairs, most)
    frequent = pairs.where(F.col("n") >= start).orderBy("code").toArrow()
    sent = aligned.sparkSession.sparkContext.broadcast(
        (frequent.column("code").to_numpy().astype(np.uint32), frequent.column("n").to_numpy(), frequent.column("best").to_numpy())
    )

    def run(batches):
        codes_known, counts, best = sent.value
        for batch in batches:
            codes, times, place = pair_codes(batch)
            at = np.minimum(np.searchsorted(codes_known, codes), max(len(codes_known) - 1, 0))
            known = codes_known[at] == codes if len(codes_known) else np.zeros(len(codes), bool)
            at, weight = at[known], times[known].astype(np.int64)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], place[known], weight * best[at])
            np.add.at(sums[1], place[known], weight * counts[at])
            left = np.bincount(place[~known], minlength=batch.num_rows)
            offsets = pa.array(np.append(0, np.cumsum(left)), pa.int32())
            rare = pa.StructArray.from_arrays([pa.array(codes[~known], pa.int64()), pa.array(times[~known], pa.int64())], ["code", "times"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(row), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(offsets, rare)],
                [row, "n_best", "count_sum", "rare"],
            )

    schema = f"{row} BIGINT, n_best BIGINT, count_sum BIGINT, rare ARRAY<STRUCT<code: BIGINT, times: BIGINT>>"
    found = stage(map_texts(aligned.select(row, "codes", "times"), run, schema))
    # No pair here is frequent, so none is a hot key.
    rest = found.select(row, F.inline("rare")).join(pairs.where(F.col("n") < start), "code").select(
        row, F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
    )
    both = found.select(row, "n_best", "count_sum").unionByName(rest)
    sums = both.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("codes", "times").join(sums, row)


def align_corpus(docs: DataFrame) -> DataFrame:
    """``doc_id, row, n_a, n_b, n_groups, n_overlaps, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``, a scan.

    ``n_links`` counts the overlaps that end together, one for each group; ``count_sum`` adds up the corpus counts of their id pairs,
    ``n_best`` counts those whose pair is the most frequent of its B id.  Repeated rows count each; a null doc_id stays null;
    other columns are ignored; an empty table gives no rows.
    """
    row = unused(docs, "row")
    aligned = stage(align(docs.select("doc_id", "text").withColumn(row, F.monotonically_increasing_id()), row))
    return look_up(aligned, stage(count_pairs(aligned)), row).select(
        "doc_id", F.col(row).alias("row"), "n_a", "n_b", "n_groups", "n_overlaps", F.col("n_groups").alias("n_links"),
        "n_best", "count_sum", "groups_sha256",
    )
