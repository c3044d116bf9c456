"""SimHash near-duplicates by deletion variants (operator 13).

A fingerprint has 64 bits.  Cut into two segments, two fingerprints that differ in at most two bits
have a segment in which they differ in at most one.  Each segment is indexed once per bit, with
that bit left out; such fingerprints therefore meet under a common variant, and an equality join and
a count of the differing bits find all links.

A bucket of many different fingerprints is not paired up.  The bits in which its members may differ are
cut into three blocks, of which links agree in at least one: so each member is indexed again by each block, within
the bucket, and what is still crowded by smaller blocks.  In the end so few bits are free that a
bucket cannot be large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelscope.llm.common import bit_map, join_by_key, map_texts, slices, unused
from fidelscope.llm.near_dedup import components
from fidelscope.session import stage

SHINGLE, DISTANCE, SEED = 3, 2, 42
SEGMENTS, WIDTH = 2, 32
#: Members of a bucket that are paired directly; larger ones are cut up, so many times.
PAIRED, CUTS = 16, 4
#: Bits of the map of buckets, 8 MB, and a factor that keeps equal keys of several slots apart in it.
CELLS, SPREAD = 1 << 26, 1_048_573
#: Shingles whose bits are summed in one step.
STEP = 1 << 16


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes; 0 without words."""
    n = len(words) - min(shingle, len(words)) + 1
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    ends = ends[len(words) - n :].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        places = zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)
        hashes = np.array([digest(view[a:b], SEED) for a, b in places], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, row: str) -> DataFrame:
    """``doc_id, row, bits``: the fingerprint as a signed long."""

    def run(batches):
        for batch, _ in slices(batches, "text", 2 << 20):
            found = np.array(
                # bytes.lower() changes A-Z only, bytes.split() cuts at ASCII white space.
                [fingerprint((t or "").encode().lower().split(), shingle) for t in batch.column("text").to_pylist()],
                np.uint64,
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column(row), pa.array(found.view(np.int64))], ["doc_id", row, "bits"]
            )

    return map_texts(
        docs.select(F.col("doc_id").cast("long"), row, "text"), run, f"doc_id BIGINT, {row} BIGINT, bits BIGINT"
    )


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def hidden(bits: Column, *places: int) -> Column:
    """``bits`` with some bits cleared."""
    mask = (1 << 64) - 1
    for place in places:
        mask &= ~(1 << place)
    return bits.bitwiseAND(F.lit(signed(mask)))


def segment(bits: Column, number: int) -> Column:
    """``bits`` with all but one segment cleared."""
    return bits.bitwiseAND(F.lit(signed(((1 << WIDTH) - 1) << number * WIDTH)))


def variants(classes: DataFrame) -> DataFrame:
    """``slot, key, bits``: each segment once per bit of it, with that bit left out.

    ``slot`` is the bit's place in the whole fingerprint and so tells the segment too.
    """
    bits = F.col("bits")
    entries = [
        F.struct(F.lit(place).alias("slot"), hidden(segment(bits, place // WIDTH), place).alias("key"))
        for place in range(SEGMENTS * WIDTH)
    ]
    return classes.select("bits", F.explode(F.array(*entries)).alias("e")).select("e.slot", "e.key", "bits")


def cell(slot: Column, key: Column) -> Column:
    """A place in the bit map of buckets; :func:`members_of` computes the same."""
    value = key.bitwiseXOR(F.shiftrightunsigned(key, WIDTH))
    mixed = value.bitwiseXOR(F.shiftrightunsigned(value, 7)).bitwiseXOR(slot.cast("long") * SPREAD)
    return mixed.bitwiseAND(F.lit(CELLS - 1))


def members_of(classes: DataFrame, buckets: DataFrame) -> DataFrame:
    """``slot, key, bits`` of all members of ``buckets (slot, key)``, and few others.

    A bit map of the buckets, of fixed size, goes to every task, so that only their members are shuffled
    and not the whole index a second time.
    """
    places = bit_map(buckets.select(cell(F.col("slot"), F.col("key")).alias("cell")), "cell", CELLS)
    shared = classes.sparkSession.sparkContext.broadcast(places)
    slots = np.arange(SEGMENTS * WIDTH, dtype=np.uint64)
    held = ~np.array(FREE, np.int64).view(np.uint64)

    def run(batches):
        places = shared.value
        for batch in batches:
            bits = batch.column("bits").to_numpy().view(np.uint64)
            keys = bits[:, None] & held
            value = keys ^ (keys >> np.uint64(WIDTH))
            at = (value ^ (value >> np.uint64(7)) ^ (slots * np.uint64(SPREAD))) & np.uint64(CELLS - 1)
            row, slot = np.nonzero(places[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot.astype(np.int32)), pa.array(keys[row, slot].view(np.int64)), pa.array(bits[row].view(np.int64))],
                ["slot", "key", "bits"])

    return classes.select("bits").mapInArrow(run, "slot INT, key BIGINT, bits BIGINT")


def near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


#: Per slot the bits that may differ within a bucket: the one left out and the other segment.
FREE = [signed((1 << place) | (((1 << WIDTH) - 1) << (1 - place // WIDTH) * WIDTH)) for place in range(SEGMENTS * WIDTH)]


def block(cut: int, number: int) -> int:
    """The bits of a block: those whose place has ``number`` as its digit ``cut`` to the base 3, and in the
    last cut as the sum of its digits."""
    digits = lambda place: [place // 3**i % 3 for i in range(3)]
    of = lambda place: digits(place)[cut] if cut < 3 else sum(digits(place)) % 3
    return sum(1 << place for place in range(64) if of(place) == number)


def fixed(free: str = "free") -> Column:
    return F.col("bits").bitwiseAND(F.bitwise_not(F.col(free)))


def bucket_pairs(members: DataFrame) -> DataFrame:
    """Links ``a, b`` within buckets of ``members (free, fixed, bits)``."""
    other = members.select("free", "fixed", F.col("bits").alias("b"))
    joined = members.select("free", "fixed", F.col("bits").alias("a")).join(other, ["free", "fixed"])
    return joined.where((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b")


def links(classes: DataFrame) -> DataFrame:
    """All pairs ``a, b`` within two bits; ``classes`` has distinct ``bits``.

    Two that differ in one bit of a segment meet in that bit's bucket, where both values of the bit
    are present; two that agree in a segment meet in all its buckets, of which the first is enough.
    """
    index = variants(classes)
    value = F.call_function("shiftrightunsigned", F.col("bits"), F.col("slot")).bitwiseAND(F.lit(1))
    found = stage(
        index.groupBy("slot", "key")
        .agg(F.count("*").alias("n"), F.min("bits").alias("a"), F.max("bits").alias("b"),
             (F.min(value) < F.max(value)).alias("both"))
        .where((F.col("n") > 1) & (F.col("both") | (F.col("slot") % WIDTH == 0)))
    )
    edges = found.where("n = 2").select("a", "b").where(near("a", "b"))
    more = found.where("n > 2").select("slot", "key", "n")
    free = F.element_at(F.array(*map(F.lit, FREE)), F.col("slot") + 1)
    level = stage(members_of(classes, more).join(more, ["slot", "key"]).select(free.alias("free"), F.col("key").alias("fixed"), "bits", "n"))
    for cut in range(CUTS):
        edges = edges.unionByName(bucket_pairs(level.where(F.col("n") <= PAIRED)))
        crowded = level.where(F.col("n") > PAIRED)
        if crowded.isEmpty():
            return edges.distinct()
        less = F.explode(F.array(*(less_free(cut, k) for k in range(3)))).alias("free")
        parts = stage(crowded.select(less, "bits").distinct().withColumn("fixed", fixed()))
        sizes = parts.groupBy("free", "fixed").agg(F.count("*").alias("n")).where("n > 1")
        level = stage(parts.join(sizes, ["free", "fixed"]))
    # After four cuts, of 33 free bits no more than ten are left.
    return edges.unionByName(bucket_pairs(level)).distinct()


def less_free(cut: int, number: int) -> Column:
    return F.col("free").bitwiseAND(F.lit(signed(((1 << 64) - 1) ^ block(cut, number))))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, row, fingerprint, component_id`` for every row of ``docs``, which must be a scan.

    Fingerprints that differ in at most two bits are linked; ``component_id`` is the smallest doc_id
    that links reach, a null doc_id after all others.  Words are lower-cased in A-Z; fewer words
    than ``shingle`` are one shingle.  A null or empty text, or one without words, has the fingerprint
    zero, which is linked like any other.  Repeated rows are linked with each other.  An empty table gives no
    rows; other columns are ignored.  Equal fingerprints are one class, so copies cost no pairs.
    """
    row = unused(docs, "row")
    numbered = docs.select("doc_id", "text").withColumn(row, F.monotonically_increasing_id())
    slim = stage(fingerprints(numbered, shingle, row))
    classes = stage(slim.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    parts = components(links(classes.select("bits")))
    placed = stage(
        classes.join(parts.withColumnRenamed("rep", "bits"), "bits", "left")
        .withColumn("component", F.coalesce("component", "bits"))
    )
    heads = stage(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    by_class = stage(
        join_by_key(placed.select("bits", "size", "component"), heads, "component", "n", placed.count())
        .select("bits", "size", "component_id")
    )
    return join_by_key(slim, by_class, "bits", "size", slim.count()).select(
        "doc_id", F.col(row).alias("row"), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
