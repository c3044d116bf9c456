"""Removal of long repeated substrings with two-stage suffix sorting (operator 4).

A byte goes if it is covered by a string of ``length`` bytes that starts anywhere else too.

1. Winnowing: every window of ``length`` bytes is led by the smallest hash of its 128-byte grams,
   so equal windows have equal leaders.  Neighbouring windows with one leader are a run.
2. Leaders that occur once cannot be in an equal window.  Of the others, each distinct run is
   cut out of its text once, with the number of its places.
3. Runs are brought together by leader, a few megabytes at a time, and their suffixes sorted in
   two stages: those smaller than their successor directly, the rest induced from these by scans of
   the buckets of first bytes.  Common prefixes of neighbours give the classes of equal windows;
   one with two places or more is a repeat.  Where all runs of a leader have several places, all
   their windows are repeats without it.
4. Repeated windows go back to all places of their run, and their bytes out of the texts.

A leader with very many distinct runs is no single group: its runs are cut into shorter ones that are
grouped by the bytes all their windows share, and in the end into single windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelscope.llm.common import join_by_key, map_texts, slices, text_bytes, unused
from fidelscope.session import stage

LENGTH = 400
#: Bytes of a gram, a power of two below ``length``.
GRAM = 128
#: More distinct runs than this under one leader are cut up.
GROUP_RUNS = 1_024
#: Windows in a run when it is cut up for the first and for the second time.
CUTS = (16, 1)
#: Bytes that are suffix-sorted at a time.
BLOCK_BYTES = 2 << 20
SEGMENT = 8 << 20
UNIT = "leader BIGINT, run BIGINT, weight BIGINT, windows BIGINT, lead BIGINT, body BINARY"
PLACE_BITS = np.uint64((1 << 24) - 1)

BYTE_CODES = np.random.default_rng(128).integers(0, 1 << 64, 256, dtype=np.uint64)
FACTOR = 0x9E3779B97F4A7C15


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram that starts at each byte, by doubling."""
    h, size, factor = BYTE_CODES[data], 1, FACTOR
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor % (1 << 64)
        size *= 2
    return spread(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs_of(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs in texts laid end to end: first window, number of windows, leader's place and hash."""
    none = *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)
    if len(data) < length:
        return none
    hashes = gram_hashes(data)
    places = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min((hashes & ~PLACE_BITS) | (PLACE_BITS - places), length - GRAM + 1)
    leader = (PLACE_BITS - (least & PLACE_BITS)).astype(np.int64)
    valid = np.zeros(len(leader) + 1, np.int64)
    sizes = np.diff(starts)
    long = sizes >= length
    valid[starts[:-1][long]] += 1
    valid[starts[1:][long] - length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(windows):
        return none
    of = leader[windows]
    first = np.r_[True, (np.diff(windows) != 1) | (np.diff(of) != 0)]
    # Texts that touch have no valid window across their border, but the gap may be closed.
    first[np.searchsorted(windows, starts[:-1][long])] = True
    at = np.flatnonzero(first)
    return windows[at], np.diff(np.append(at, len(windows))), of[at], hashes[of[at]]


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple]:
    """Parts of the texts of at most 8 MB, overlapping so that each window is in one part."""
    small = np.diff(offsets) <= SEGMENT
    for i in np.flatnonzero(~small):
        for a in range(offsets[i], offsets[i + 1] - length + 1, SEGMENT - length + 1):
            part = data[a : min(a + SEGMENT, offsets[i + 1])]
            yield part, np.array([0, len(part)]), np.array([i]), np.array([a - offsets[i]])
    start = 0
    n = len(small)
    while start < n:
        stop = start
        while stop < n and small[stop] and offsets[stop + 1] - offsets[start] <= SEGMENT:
            stop += 1
        if stop > start:
            yield (data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start],
                   np.arange(start, stop), np.zeros(stop - start, np.int64))
        start = max(stop, start + 1) if stop == start else stop


def find_runs(docs: DataFrame, row: str, length: int) -> DataFrame:
    """``leader, run, row, start, windows, lead``: all runs of all texts, hashed."""

    def run(batches):
        for batch, _ in slices(batches, "text", 2 << 20):
            data, offsets = text_bytes(batch.column("text"))
            rows = batch.column(row).to_numpy()
            for part, starts, texts, shifts in segments(data, offsets, length):
                first, count, place, leader = runs_of(part, starts, length)
                raw = memoryview(np.ascontiguousarray(part))
                hashed = np.fromiter(
                    (xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in
                     zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)),
                    np.uint64, len(first),
                )
                of = np.searchsorted(starts, first, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leader.view(np.int64)), pa.array(hashed.view(np.int64)),
                     pa.array(rows[texts[of]]), pa.array(first - starts[of] + shifts[of]), pa.array(count),
                     pa.array(place - first)],
                    ["leader", "run", "row", "start", "windows", "lead"],
                )

    return map_texts(docs.select(row, "text"), run,
                     "leader BIGINT, run BIGINT, row BIGINT, start BIGINT, windows BIGINT, lead BIGINT")


def cut_out(docs: DataFrame, places: DataFrame, row: str, length: int) -> DataFrame:
    """``leader, run, weight, windows, lead, body``: the bytes of one place of each run."""
    lists = places.groupBy("row").agg(
        F.collect_list(F.struct("leader", "run", "weight", "start", "windows", "lead")).alias("places"))
    joined = docs.select(F.col(row).alias("row"), "text").join(lists, "row").select("text", "places")

    def run(batches):
        for batch, _ in slices(batches, "text", 2 << 20):
            data, offsets = text_bytes(batch.column("text"))
            column = batch.column("places")
            flat = column.flatten()
            counts = np.diff(column.offsets.to_numpy())
            base = np.repeat(offsets[:-1], counts)
            start = flat.field("start").to_numpy() + base
            end = start + flat.field("windows").to_numpy() + length - 1
            raw = data.tobytes()
            body = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [flat.field(n) for n in names[:-1]] + [pa.array(body, pa.binary())], names
            )

    names = [c.split()[0] for c in UNIT.split(", ")]
    return map_texts(joined, run, UNIT)


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of at least their first ``depth`` values; ties in any order.

    ``text`` holds small numbers and ends with a 0 that is smaller than all between its parts.
    With ``wanted``, a mask, only these suffixes and those that place them are sorted and returned.
    """
    n = len(text)
    # A suffix is smaller than its successor if the next other value is larger.
    change = np.where(np.append(text[:-1] != text[1:], True), np.arange(n), n - 1)
    following = np.minimum.accumulate(change[::-1])[::-1]
    small = np.ones(n, bool)
    inner = following < n - 1
    small[inner] = text[following[inner]] < text[following[inner] + 1]
    small[text == 0] = True
    needed = np.ones(n, bool)
    if wanted is not None:
        # A larger suffix is placed by its successor, and so on up to the next smaller one.
        number = np.arange(n)
        asked = np.maximum.accumulate(np.where(wanted, number, -1))
        ended = np.maximum.accumulate(np.where(small, number, -1))
        needed = asked > np.append(-1, ended[:-1])

    chunks = eight(text)
    direct = np.flatnonzero(small & needed)
    key = chunks[direct]
    order = np.argsort(key, kind="stable")
    direct, key = direct[order], key[order]
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]])
    tied = ties(group)
    group = group[tied]
    # Only ties are compared by the next eight values, and only while they are ties.
    for at in range(8, depth, 8):
        if not len(tied):
            break
        key = chunks[np.minimum(direct[tied] + at, n - 1)]
        # Most ties go on for the next values too; the others alone are sorted.
        parted = np.zeros(int(group[-1]) + 1, bool)
        parted[group[1:][(key[1:] != key[:-1]) & (group[1:] == group[:-1])]] = True
        some = np.flatnonzero(parted[group])
        order = some[np.lexsort((key[some], group[some]))]
        direct[tied[some]], key[some] = direct[tied[order]], key[order]
        group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        still = ties(group)
        tied, group = tied[still], group[still]

    larger = needed & ~small
    # Second stage: a larger suffix is placed by the one behind it, bucket after bucket.
    first = text[direct]
    borders = np.searchsorted(first, np.arange(int(text.max()) + 2))
    waiting: list[list[np.ndarray]] = [[] for _ in range(int(text.max()) + 1)]
    out = []

    def send(found: np.ndarray, char: int) -> np.ndarray:
        """Put larger predecessors into their buckets; return those of this bucket."""
        before = found[found > 0] - 1
        before = before[larger[before]]
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        cuts = np.append(np.flatnonzero(np.append(True, chars[1:] != chars[:-1])[: len(chars)]), len(chars))
        own = before[:0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if chars[a] == char:
                own = before[a:b]
            else:
                waiting[chars[a]].append(before[a:b])
        return own

    for char in range(len(waiting)):
        wave = np.concatenate(waiting[char]) if waiting[char] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = send(wave, char)
        some = direct[borders[char] : borders[char + 1]]
        if len(some):
            out.append(some)
            send(some, char)
    return np.concatenate(out)


def ties(group: np.ndarray) -> np.ndarray:
    """Places whose neighbour has the same (sorted) group."""
    same = group[1:] == group[:-1]
    both = np.zeros(len(group), bool)
    both[1:] |= same
    both[:-1] |= same
    return np.flatnonzero(both)


def eight(text: np.ndarray) -> np.ndarray:
    """Eight values from each place on, as one number."""
    padded = np.append(text, np.zeros(8, text.dtype)).astype(np.uint64)
    found = np.zeros(len(text), np.uint64)
    for i in range(8):
        # Values reach 256 only in the byte 0xFF, which UTF-8 does not have.
        found = (found << np.uint64(8)) | np.minimum(padded[i : i + len(text)], 255)
    return found


def repeated_windows(bodies: list[bytes], windows: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """For all windows of all runs in a row, whether another place has the same bytes."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    text = np.zeros(int(sizes.sum()) + len(bodies), np.uint16)
    starts = np.append(0, np.cumsum(sizes + 1))[:-1]
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = False
    text[inside] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint16) + 1
    index = np.full(len(text), -1, np.int64)
    of = np.repeat(np.arange(len(bodies)), windows)
    place = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + starts[of]
    index[place] = np.arange(len(place))
    order = suffix_array(text, length, index >= 0)
    order = order[index[order] >= 0]
    # Common prefixes of neighbours, eight bytes at a time, as far as they can matter.
    chunks = eight(text)
    common = np.zeros(len(order) - 1, np.int64)
    pairs = np.arange(len(common))
    for at in range(0, length, 8):
        step = min(8, length - at)
        back = length - 8 if step < 8 else at
        equal = chunks[order[pairs] + back] == chunks[order[pairs + 1] + back]
        pairs = pairs[equal]
        common[pairs] += step
    group = np.cumsum(np.r_[True, common < length]) - 1
    number = index[order]
    total = np.bincount(group, weights[of[number]])
    found = np.zeros(len(place), bool)
    found[number] = total[group] > 1
    return found


def repeated_of_leaders(table: pa.Table, length: int) -> np.ndarray:
    """``repeated_windows`` of a table of runs, all those of a leader side by side.

    All windows of a run with several places are repeated, so only a leader with a run of one place is open.
    """
    leaders, weights, windows = (table[c].to_numpy() for c in ("leader", "weight", "windows"))
    first = np.r_[True, leaders[1:] != leaders[:-1]]
    open_ = (np.minimum.reduceat(weights, np.flatnonzero(first)) == 1)[np.cumsum(first) - 1]
    found = np.ones(int(windows.sum()), bool)
    if open_.any():
        bodies = table["body"].filter(pa.array(open_)).to_pylist()
        found[np.repeat(open_, windows)] = repeated_windows(bodies, windows[open_], weights[open_], length)
    return found


def sort_runs(units: DataFrame, length: int) -> DataFrame:
    """``leader, run, first, last``: stretches of repeated windows in each run."""
    names = ["leader", "run", "weight", "windows", "body"]

    def flush(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        windows = table["windows"].to_numpy()
        found = repeated_of_leaders(table, length)
        starts = np.append(0, np.cumsum(windows))
        of = np.repeat(np.arange(len(windows)), windows)
        edge = np.r_[True, of[1:] != of[:-1]]
        begin = np.flatnonzero(found & (edge | ~np.r_[False, found[:-1]]))
        end = np.flatnonzero(found & (np.r_[edge[1:], True] | ~np.r_[found[1:], False]))
        of = of[begin]
        take = pa.array(of)
        return pa.RecordBatch.from_arrays(
            [table["leader"].combine_chunks().take(take), table["run"].combine_chunks().take(take),
             pa.array(begin - starts[of]), pa.array(end - starts[of])],
            ["leader", "run", "first", "last"],
        )

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            leaders = batch.column("leader").to_numpy()
            cuts = np.flatnonzero(np.r_[True, leaders[1:] != leaders[:-1]])
            lengths = np.cumsum(batch.column("windows").to_numpy() + length)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(leaders)], strict=True):
                if size >= BLOCK_BYTES and leaders[a] != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(lengths[b - 1] - (lengths[a - 1] if a else 0))
                last = leaders[a]
        if held:
            yield flush(held)

    together = units.select(*names).repartition("leader").sortWithinPartitions("leader")
    return map_texts(together, run, "leader BIGINT, run BIGINT, first BIGINT, last BIGINT")


def cut_up(units: DataFrame, size: int, length: int) -> DataFrame:
    """Runs cut into parts of ``size`` windows, at fixed distances from their leading gram.

    Returns ``of_leader, of_run, shift`` and the part as a unit.  The new leader is the hash of
    the bytes that all windows of a part share, so equal windows are still under one leader.
    """
    names = ["of_leader", "of_run", "shift", *(c.split()[0] for c in UNIT.split(", "))]
    types = [pa.int64()] * 8 + [pa.binary()]

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                start, lead, body = 0, row["lead"], row["body"]
                while start < row["windows"]:
                    number = (start - lead) // size
                    grid = lead + number * size
                    stop = min(row["windows"], grid + size)
                    part = body[start : stop + length - 1]
                    shared = xxhash.xxh3_64_intdigest(body[grid + size - 1 : grid + length], number % (1 << 32))
                    rows.append((row["leader"], row["run"], start, signed(shared) ^ row["leader"],
                                 signed(xxhash.xxh3_64_intdigest(part)), row["weight"], stop - start, lead - start, part))
                    start = stop
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return map_texts(units, run, f"of_leader BIGINT, of_run BIGINT, shift BIGINT, {UNIT}")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def find_repeats(units: DataFrame, length: int, cuts: tuple[int, ...] = CUTS, most: int = GROUP_RUNS) -> DataFrame:
    """``leader, run, first, last``: stretches of repeated windows in each run of ``units``."""
    if not cuts:
        # Single windows: distinct ones never meet, so any order of blocks will do.
        found = sort_runs(units.withColumn("leader", F.col("run")).withColumn("run", F.col("of")), length)
        return found.select(F.col("run").alias("leader"), F.col("leader").alias("run"), "first", "last")
    crowded = stage(units.groupBy("leader").count().where(F.col("count") > most).select("leader"))
    if crowded.isEmpty():
        return sort_runs(units, length)
    easy = sort_runs(units.join(crowded, "leader", "left_anti"), length)
    parts = stage(cut_up(units.join(crowded, "leader", "left_semi").select(*names_of(UNIT)), cuts[0], length))
    smaller = stage(
        parts.groupBy("leader", "run")
        .agg(F.sum("weight").alias("weight"), *(F.min(c).alias(c) for c in ("windows", "lead", "body")))
        .withColumn("of", F.col("leader"))
    )
    found = stage(find_repeats(smaller, length, cuts[1:], most))
    back = parts.select("of_leader", "of_run", "shift", "leader", "run").join(found, ["leader", "run"])
    return easy.unionByName(back.select(
        F.col("of_leader").alias("leader"), F.col("of_run").alias("run"),
        (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last")))


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def remove_repeats(docs: DataFrame, length: int = LENGTH, most: int = GROUP_RUNS) -> DataFrame:
    """``doc_id, row, n_bytes, n_removed, spans, kept`` for every row of ``docs``, a plain scan.

    A byte of a text, as UTF-8, goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in the same text too; all strings are judged on the input.  ``spans`` are the
    removed stretches (``start``, ``end`` behind the last byte), ``kept`` the other bytes in one,
    which may have cut a character.  A null text is empty, and shorter texts stay whole.
    Repeated rows are places of their own.  ``row`` numbers the rows of the scan.
    """
    row = unused(docs, "row")
    numbered = docs.select(F.col("doc_id").cast("long"), "text").withColumn(row, F.monotonically_increasing_id())
    runs = stage(find_runs(numbered, row, length))
    leaders = stage(runs.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1"))
    shared = stage(
        join_by_key(runs, leaders, "leader", "n", runs.count()).drop("n")
        .withColumn("id", F.struct("leader", "run"))
    )
    places = stage(shared.groupBy("leader", "run").agg(
        F.min(F.struct("row", "start", "windows", "lead")).alias("at"), F.count("*").alias("weight")
    ).select("leader", "run", "weight", "at.*"))
    units = stage(cut_out(numbered, places, row, length))
    found = stage(find_repeats(units, length, most=most))
    stretches = found.groupBy("leader", "run").agg(F.collect_list(F.struct("first", "last")).alias("stretches"))
    answers = stage(
        stretches.join(places.select("leader", "run", "weight"), ["leader", "run"])
        .select(F.struct("leader", "run").alias("id"), "weight", "stretches")
    )
    covered = join_by_key(shared.select("id", "row", "start"), answers, "id", "weight", shared.count())
    spans = covered.select("row", "start", F.explode("stretches").alias("s")).select(
        F.col("row").alias(row), (F.col("start") + F.col("s.first")).alias("a"),
        (F.col("start") + F.col("s.last") + length).alias("b"))
    lists = spans.groupBy(row).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return map_texts(numbered.join(lists, row, "left").select("doc_id", F.col(row).alias("row"), "text", "spans"),
                     remove, RESULT)


RESULT = (
    "doc_id BIGINT, row BIGINT, n_bytes BIGINT, n_removed BIGINT,"
    " spans ARRAY<STRUCT<start: BIGINT, end: BIGINT>>, kept BINARY"
)


def remove(batches):
    for batch, _ in slices(batches, "text", 2 << 20):
        data, offsets = text_bytes(batch.column("text"))
        raw, spans, kept, removed = data.tobytes(), [], [], []
        for i, marks in enumerate(batch.column("spans").to_pylist()):
            body = raw[offsets[i] : offsets[i + 1]]
            joined = []
            for a, b in sorted((m["a"], m["b"]) for m in marks or ()):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            spans.append([{"start": a, "end": b} for a, b in joined])
            removed.append(sum(b - a for a, b in joined))
            ends = [0, *(x for pair in joined for x in pair), len(body)]
            kept.append(b"".join(body[ends[j] : ends[j + 1]] for j in range(0, len(ends), 2)))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
             pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
            ["doc_id", "row", "n_bytes", "n_removed", "spans", "kept"],
        )
