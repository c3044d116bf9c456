"""Hierarchical packing of documents into context windows of several lengths (operator 3).

Each task packs its own rows, so nothing is shuffled and only what waits for a window is held.
A document's full longest windows stand alone; the rest is routed to the shortest tier that holds
it.  Tiers are packed from the longest down: a window takes one piece of its tier, and its gap
is filled from shorter ones, the last of which is cut to fit.  So only the last window of a
task can need padding.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelscope.llm.common import map_texts, slices
from fidelscope.llm.tokens import tokenizer_path, worker_encoder

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Pieces wait until they have this many windows' worth of tokens, so that fits can be chosen.
POOL_WINDOWS = 64
#: Sequences of one tier form steps of this many longest windows' tokens.
STEP_WINDOWS = 16
SCHEMA = (
    "doc_id BIGINT, start BIGINT, length BIGINT, doc_tokens BIGINT, sequence_id BIGINT,"
    " offset BIGINT, tier INT, step_id BIGINT, ids BINARY"
)


@dataclass(order=True)
class Piece:
    length: int
    serial: int
    start: int = field(compare=False)
    ids: memoryview = field(compare=False)
    doc: tuple = field(compare=False)

    def cut(self, length: int) -> tuple[Piece, Piece]:
        head = Piece(length, self.serial, self.start, self.ids[: 4 * length], self.doc)
        tail = Piece(self.length - length, self.serial, self.start + length, self.ids[4 * length :], self.doc)
        return head, tail


class Packer:
    """Packs one task's documents; ``rows`` collects finished pieces in the order of SCHEMA."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, first: int = 0, pool: int = POOL_WINDOWS):
        self.tiers = sorted(tiers)
        self.longest = self.tiers[-1]
        self.pool = pool * self.longest
        self.waiting: dict[int, list[Piece]] = {t: [] for t in self.tiers}
        self.tokens = 0
        self.next = first
        self.made = dict.fromkeys(self.tiers, 0)
        self.first = first
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        view, n = memoryview(ids), len(ids) // 4
        whole = Piece(n, 0, 0, view, (doc_id, n))
        while whole.length >= self.longest:
            head, whole = whole.cut(self.longest)
            self.emit(self.longest, [head])
        if whole.length:
            whole.serial = self.tokens
            self.wait(whole)
        if self.tokens >= self.pool:
            self.pack()

    def wait(self, piece: Piece) -> None:
        self.waiting[next(t for t in self.tiers if t >= piece.length)].append(piece)
        self.tokens += piece.length

    def emit(self, tier: int, pieces: list[Piece]) -> None:
        per_step = STEP_WINDOWS * self.longest // tier
        step = self.made[tier] // per_step * len(self.tiers) + self.tiers.index(tier)
        self.made[tier] += 1
        offset = 0
        for p in pieces:
            self.rows.append((p.doc[0], p.start, p.length, p.doc[1], self.next, offset, tier,
                              self.first + step, bytes(p.ids)))
            offset += p.length
        self.next += 1

    def pack(self, last: bool = False) -> None:
        """Fill windows while a full one can be made; ``last`` also closes the final ones."""
        pieces = sorted(p for tier in self.waiting.values() for p in tier)
        rest = sum(p.length for p in pieces)
        while pieces and (rest >= self.longest or last):
            head = pieces.pop()
            tier = next(t for t in self.tiers if t >= head.length)
            if rest < tier:
                # The task's last tokens: full shorter windows, then one that is padded.
                tier = next((t for t in reversed(self.tiers) if t <= rest), self.longest)
            window, gap = [], min(tier, rest)
            rest -= gap
            piece = head
            while gap:
                if piece.length > gap:
                    piece, tail = piece.cut(gap)
                    pieces.insert(bisect_right(pieces, tail), tail)
                window.append(piece)
                gap -= piece.length
                if gap:
                    # The longest that fits; the shortest of all is cut where none does.
                    at = bisect_right(pieces, gap, key=lambda p: p.length)
                    piece = pieces.pop(at - 1 if at else 0)
            self.emit(tier, window)
        self.waiting = {t: [] for t in self.tiers}
        self.tokens = 0
        for p in pieces:
            self.wait(p)

    def take(self) -> pa.RecordBatch:
        types = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
        columns = list(zip(*self.rows, strict=True)) or [()] * len(types)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
        )


def pack(
    docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID
) -> DataFrame:
    """Pieces of token ids with their places in the packed sequences.

    ``docs`` needs ``doc_id`` and ``text``.  A document is its ids and then ``end_id``; a null or
    empty text is the ``end_id`` alone.  Documents may be cut anywhere; each id is in exactly one
    piece.  Repeated rows are packed one by one; a null doc_id stays null.  ``sequence_id`` holds
    the task's number above 33 bits, ``step_id`` groups sequences of one tier with equal tokens,
    ``ids`` are little-endian unsigned 32-bit integers.  An empty table gives no rows.

    A task that is run again packs the same rows the same way.  Sequences depend on the split of
    the input into tasks; every document is packed whole whatever the split.
    """
    path = tokenizer or tokenizer_path()

    def run(batches):
        encoder = worker_encoder(path)
        packer = Packer(tiers, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], "<u4").tobytes()
        for batch, _ in slices(batches, "text", 2 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                packer.add(doc_id, ids + end)
            if packer.rows:
                yield packer.take()
        packer.pack(last=True)
        yield packer.take()

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
