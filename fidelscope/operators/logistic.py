"""Logistic losses of several classes over the same rows, minimised together.

Rows lie as small sparse blocks.  One pass over them gives the loss and the gradient
of every class, summed within each task and then through a tree, so the driver takes in a few sums
a pass, however many tasks there are.  Each class takes its own quasi-Newton step from its pass; one pass is one iteration
of all classes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums that one task of the tree adds up, and the driver: a sum has all weights, and every pass sends it.
FAN_IN, AT_DRIVER = 64, 4
#: Steps that a quasi-Newton direction remembers.  The more rows, the less the penalty evens the losses out, and with
#: few steps kept the passes grow with the root of the rows; two vectors of all weights a step stay small on the driver.
MEMORY = 200
#: Rows of a block: its entries stay in the processor's cache, and no task holds large arrays.
BLOCK_ROWS = 128
BLOCK = "classes BINARY, sizes BINARY, places BINARY, values BINARY"


def sparse_blocks(rows: DataFrame, features: str, label: str) -> DataFrame:
    """``rows`` as blocks: labels, entries per row, and the entries' places and values.

    Places have two bytes in blocks where that is enough, else four.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, BLOCK_ROWS) for b in batches for a in range(0, b.num_rows, BLOCK_ROWS)):
            vector = batch.column("v")
            values, places = vector.field("values"), vector.field("indices")
            sizes = np.diff(values.offsets.to_numpy()).astype(np.int32)
            # A dense vector has no indices: its places count from 0.
            dense = places.is_null().to_numpy(zero_copy_only=False)
            found = places.flatten().to_numpy().astype(np.int32)
            if dense.any():
                parts = np.split(found, np.cumsum(np.where(dense, 0, sizes))[:-1])
                found = np.concatenate([np.arange(n, dtype=np.int32) if d else p for n, d, p in zip(sizes, dense, parts, strict=True)])
            found = found.astype(np.uint16) if found.max(initial=0) < 1 << 16 else found
            columns = [batch.column("c").to_numpy().astype(np.int32), sizes, found, values.flatten().to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], [c.split()[0] for c in BLOCK.split(", ")])

    return rows.select(F.col(label).cast("int").alias("c"), F.unwrap_udt(features).alias("v")).mapInArrow(run, BLOCK)


def add_rows(
    total: np.ndarray, weights: np.ndarray, cost: np.ndarray, size: np.ndarray, place: np.ndarray, value: np.ndarray
) -> None:
    """Add loss and gradient of every class over some rows to ``total``; ``cost`` has them by class and row."""
    row = np.repeat(np.arange(len(size)), size)
    full = np.flatnonzero(size)
    first = (np.cumsum(size) - size)[full]
    score = np.zeros(len(size))
    for k, w in enumerate(weights):
        if len(full):
            score[full] = np.add.reduceat(w.take(place) * value, first)
        margin = np.sign(cost[k]) * score
        total[k, 0] += np.abs(cost[k]) @ np.logaddexp(0.0, -margin)
        # The loss falls by this much per unit of a row's score.
        pull = cost[k] * np.exp(-np.logaddexp(0.0, margin))
        total[k, 1:] -= np.bincount(place, value * pull.take(row), weights.shape[1])


def evaluate(blocks: DataFrame, parts: int, weights: np.ndarray, costs: np.ndarray, labels: Sequence[int]):
    """Loss and gradient of every class at its row of ``weights``, in one pass.

    ``costs[k, j]`` is what a row of ``labels[j]`` costs class ``k``; the sign says on which side it
    is.  ``parts`` is the number of partitions of ``blocks``.
    """
    order = np.asarray(labels)

    def add(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def run(batches):
        total = np.zeros((len(weights), weights.shape[1] + 1))
        for batch in batches:
            for c, s, p, v in zip(*(batch.column(i) for i in range(4)), strict=True):
                label, size = np.frombuffer(c.as_buffer(), np.int32), np.frombuffer(s.as_buffer(), np.int32)
                value = np.frombuffer(v.as_buffer(), np.float64)
                place = np.frombuffer(p.as_buffer(), np.uint16 if len(p.as_buffer()) == 2 * len(value) else np.int32)
                add_rows(total, weights, costs[:, np.searchsorted(order, label)], size, place.astype(np.intp), value)
        return add(total)

    def merge(batches):
        sums = [(p.as_py(), np.frombuffer(x.as_buffer())) for b in batches for p, x in zip(*b.columns, strict=True)]
        # Added in the order of the parts, whichever arrives first.
        sums = [total for _, total in sorted(sums, key=lambda s: s[0])]
        return add(np.sum(sums, axis=0).reshape(len(weights), -1)) if sums else iter(())

    schema = "part INT, total BINARY"
    sums = blocks.mapInArrow(run, schema)
    while parts > AT_DRIVER:
        parts = -(-parts // FAN_IN)
        sums = sums.repartition(parts, F.col("part") % parts).mapInArrow(merge, schema)
    total = np.zeros((len(weights), weights.shape[1] + 1))
    for r in sums.collect():
        total += np.frombuffer(bytes(r.total)).reshape(total.shape)
    return total[:, 0], total[:, 1:]


@dataclass
class Descent:
    """A limited-memory quasi-Newton descent of one smooth convex function.

    ``trial`` is where the function is to be evaluated next, ``done`` tells that its gradient's norm
    has fallen to ``tol`` times the first one's.
    """

    point: np.ndarray
    tol: float
    done: bool = False
    first: float | None = None
    steps: list = field(default_factory=list)
    value: float = np.inf
    slope: np.ndarray | None = None
    direction: np.ndarray | None = None
    length: float = 1.0

    @property
    def trial(self) -> np.ndarray:
        return self.point if self.done or self.direction is None else self.point + self.length * self.direction

    def take(self, value: float, slope: np.ndarray) -> None:
        """Use the value and gradient at ``trial``: accept the step or shorten it."""
        if self.done:
            return
        if self.direction is not None:
            fall = self.slope @ self.direction
            if value > self.value + 1e-4 * self.length * fall:
                # The minimum of the parabola through what is known, within bounds.
                curve = 2 * (value - self.value - self.length * fall)
                self.length *= min(max(-self.length * fall / curve, 0.1), 0.5)
                # Rounding hides what is left to gain.
                self.done = self.length * np.abs(self.direction).max() < 1e-15
                return
            moved, turned = self.length * self.direction, slope - self.slope
            if moved @ turned > 0:
                self.steps = [*self.steps[-MEMORY + 1 :], (moved, turned, moved @ turned)]
            self.point = self.point + moved
        self.value, self.slope = value, slope
        norm = np.linalg.norm(slope)
        self.first = norm if self.first is None else self.first
        self.done = norm <= self.tol * self.first
        self.direction, self.length = -self.inverse(slope), 1.0
        if not self.steps:
            self.length = min(1.0, 1.0 / max(norm, 1e-300))

    def inverse(self, slope: np.ndarray) -> np.ndarray:
        """The gradient times the approximate inverse of the second derivatives."""
        left, kept = slope.copy(), []
        for moved, turned, both in reversed(self.steps):
            share = moved @ left / both
            kept.append(share)
            left -= share * turned
        if self.steps:
            _, turned, both = self.steps[-1]
            left *= both / (turned @ turned)
        for (moved, turned, both), share in zip(self.steps, reversed(kept), strict=True):
            left += (share - turned @ left / both) * moved
        return left


def minimise(
    blocks: DataFrame, width: int, costs: np.ndarray, labels: Sequence[int], penalty: float, tol: float, max_iter: int
) -> np.ndarray:
    """Weights of all classes, each the minimum of its loss plus ``penalty / 2 · |w|²``.

    Stops when every gradient is ``tol`` times its first one or shorter, after ``max_iter`` passes at most.
    """
    parts = blocks.rdd.getNumPartitions()
    fits = [Descent(np.zeros(width), tol) for _ in costs]
    for _ in range(max_iter + 1):
        # A class at its minimum needs no more passes.
        open_ = [k for k, fit in enumerate(fits) if not fit.done]
        if not open_:
            break
        trials = np.stack([fits[k].trial for k in open_])
        losses, slopes = evaluate(blocks, parts, trials, costs[open_], labels)
        for k, w, loss, slope in zip(open_, trials, losses, slopes, strict=True):
            fits[k].take(loss + penalty / 2 * (w @ w), slope + penalty * w)
    return np.stack([fit.point for fit in fits])
