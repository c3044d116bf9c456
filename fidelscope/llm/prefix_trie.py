"""Prefix trie of conversations (operator 11).

A node is a sequence of first turns.  Its key is a running sum of 128-bit turn hashes that depend on
the place, so a key and that of its parent lie in one row.  A count-min sketch of all keys screens
them: an estimate of one proves that a single conversation has this prefix, and the row is a node
of its own, written out where it is.  Only the other prefixes are shuffled and grouped exactly.

A node is named by its smallest member.  What a subtree adds up (leaves, saved bytes) is first summed
along the conversation that names the nodes, then sent from there to the nodes above that others name.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelscope.llm.common import bit_map, join_by_key, map_texts
from fidelscope.session import stage

#: Turns of one conversation in one group of a running sum.
SPAN = 4_096
#: Characters of a text that order turns of equal number and role, before its hash does.
START = 32
#: Counters in each of the sketch's two rows: several per prefix, never more than 2**27, which
#: bounds the broadcast bit map at 32 MB.
CELLS_PER_KEY, MOST_CELLS = 4, 1 << 27
#: Ends of a node are joined in pieces of so many consecutive ids.
IDS = 16_384
HALF = (1 << 32) - 1
NO_ENDS = sha256(b"").hexdigest()
PARTS = ("w0", "w1", "w2", "w3")


def number_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, content, other, bytes``: turns numbered from 1 in their conversation.

    Ordered by turn, nulls first; turns of equal number by role, start of the text and hash.  Null
    roles and texts are empty, rows without a conv_id belong to no conversation.  ``content`` and
    ``other`` are hashes of role and text.  Rows are dealt out by ranges of that order, so one
    conversation may span many tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = stage(
        conversations.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
            F.substring(text, 1, START).alias("start"),
            F.xxhash64(F.lit(1), role, text).alias("content"), F.xxhash64(F.lit(2), role, text).alias("other"),
            F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at"),
        )
    )
    order = ["turn", "role", "start", "content", "at"]
    placed = stage(slim.repartitionByRange("conv_id", *order).withColumn("block", F.spark_partition_id()))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # At most one conversation crosses from one block to the next: fewer rows than blocks.
    before = (
        placed.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(earlier)).where("before > 0").drop("n")
    )
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order))
    return (
        placed.withColumn("place", within.cast("long")).join(F.broadcast(before), ["conv_id", "block"], "left")
        .select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "content", "other", "bytes")
    )


def splice(turns: DataFrame, family: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from the first of their family.

    Conversation ``c`` gets the first ``h = crc32(c) % longest`` turns of conversation ``c - c % family``
    (fewer if it has fewer, none if there is none) and then its own turns after its first ``h``.
    Returns the turns ``conv_id, place, length, …`` and all conversations ``conv_id, length``, those
    without a turn too.
    """
    turns = stage(turns)
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).alias("h")
    sizes = stage(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = stage(
        sizes.select("conv_id", "n", head, (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
        .join(first, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
        .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv_id", "n", "h", "base", "taken", "length")
    )
    own = join_by_key(turns.where(F.col("place") > head), plan.drop("base"), "conv_id", "n", turns.count())
    heads = turns.where((F.col("place") < longest) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    taken = heads.join(plan.select("conv_id", "base", "h", "length"), "base").where(F.col("place") <= F.col("h"))
    columns = ["conv_id", "place", "length", "content", "other", "bytes"]
    moved = own.withColumn("place", F.col("taken") + F.col("place") - F.col("h"))
    return moved.select(*columns).unionByName(taken.select(*columns)), plan.select("conv_id", "length")


def running(rows: DataFrame, key: str, place: Column, length: Column, sums: tuple[str, ...]) -> DataFrame:
    """Replace ``sums`` by their running sums along ``place`` (from 0) within each ``key``.

    Sums run within blocks of ``SPAN`` places; the totals of earlier blocks are added to those of
    the keys that are longer, so no key gathers in one task.
    """
    rows = rows.withColumn("block", F.floor(place / SPAN))
    within = Window.partitionBy(key, "block").orderBy(place)
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.where(length > SPAN).groupBy(key, "block").agg(*(F.sum(s).alias(s) for s in sums))
        .select(key, "block", *(F.sum(s).over(earlier).alias(f"before_{s}") for s in sums)).where("block > 0")
    )
    added = {s: F.col(s) + F.coalesce(f"before_{s}", F.lit(0)) for s in sums}
    return (
        rows.withColumns({s: F.sum(s).over(within) for s in sums}).join(before, [key, "block"], "left")
        .withColumns(added).drop("block", *(f"before_{s}" for s in sums))
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, length, bytes, key, up``: each conversation's prefixes, their parents' keys."""
    low, high = lambda c: c.bitwiseAND(F.lit(HALF)), lambda c: F.shiftrightunsigned(c, 32)
    one, two = (F.xxhash64(F.lit(seed), "place", "content", "other") for seed in (3, 4))
    hashed = turns.withColumns({"o0": low(one), "o1": high(one), "o2": low(two), "o3": high(two)})
    parts = hashed.withColumns({w: F.col(o) for w, o in zip(PARTS, ("o0", "o1", "o2", "o3"), strict=True)})
    summed = running(parts, "conv_id", F.col("place") - 1, F.col("length"), PARTS)

    def key(w0: Column, w1: Column, w2: Column, w3: Column) -> Column:
        return F.struct(
            F.shiftleft(w1, 32).bitwiseOR(low(w0)).alias("a"), F.shiftleft(w3, 32).bitwiseOR(low(w2)).alias("b")
        )

    above = [F.col(f"w{i}") - F.col(f"o{i}") for i in range(4)]
    return summed.select(
        "conv_id", F.col("place").alias("depth"), "length", "bytes",
        key(*map(F.col, PARTS)).alias("key"), key(*above).alias("up"),
    )


def sketch(paths: DataFrame, cells: int) -> np.ndarray:
    """A bit for each counter of the count-min sketch of all keys: whether it counts over one.

    The two halves of a key are its two hashes.  ``cells`` is a power of two.
    """
    mask = F.lit(cells - 1)
    places = F.array(F.col("key.a").bitwiseAND(mask), F.col("key.b").bitwiseAND(mask) + cells)
    counted = paths.select(F.explode(places).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    return bit_map(counted, "cell", 2 * cells)


def screen(paths: DataFrame, cells: int) -> DataFrame:
    """Add ``shared`` and ``up_shared``: the sketch does not prove the prefix (its parent) single."""
    sent = paths.sparkSession.sparkContext.broadcast(sketch(paths, cells))

    def run(batches):
        bits, mask = sent.value, cells - 1

        def many(key: pa.StructArray) -> pa.Array:
            a, b = (key.field(i).to_numpy(zero_copy_only=False) & mask for i in (0, 1))
            b = b + cells
            return pa.array((bits[a >> 3] >> (a & 7) & bits[b >> 3] >> (b & 7) & 1).astype(bool))

        for batch in batches:
            columns = [*batch.columns, many(batch.column("key")), many(batch.column("up"))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "shared", "up_shared"])

    kind = "STRUCT<a: BIGINT, b: BIGINT>"
    schema = f"conv_id BIGINT, depth BIGINT, length BIGINT, bytes BIGINT, key {kind}, up {kind}"
    return paths.mapInArrow(run, f"{schema}, shared BOOLEAN, up_shared BOOLEAN")


def digest_ends(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` from ``key, conv_id``: the ids in order, joined by commas, hashed.

    SHA-256 is sequential, so the ids of one node pass one hash object; they come in pieces, and no
    task holds more than some of these.
    """
    pieces = ends.groupBy("key", F.floor(F.col("conv_id") / IDS).alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("text")
    )

    def run(batches):
        last, state = None, None
        for batch in batches:
            done = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key != last:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = key, sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield rows_of(done)
        yield rows_of([] if last is None else [(last, state.hexdigest())])

    def rows_of(done):
        kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in done], kind), pa.array([d for _, d in done], pa.string())], ["key", "ends_sha256"]
        )

    sorted_pieces = pieces.repartition("key").sortWithinPartitions("key", "piece")
    return map_texts(sorted_pieces, run, "key STRUCT<a: BIGINT, b: BIGINT>, ends_sha256 STRING")


def prefix_trie(turns: DataFrame, conversations: DataFrame, cells: int | None = None) -> DataFrame:
    """The nodes of the trie over ``turns (conv_id, place, length, content, other, bytes)``.

    ``conversations (conv_id, length)`` names all of them once, those without a turn too; places run
    from 1 to the length.  Returns ``conv_id`` (the smallest member), ``depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens`` (bytes of the last text that its node saves, over
    the subtree), ``ends_sha256`` (of the ids that end here) and ``last_bytes``.  Without
    conversations there is no node.  ``cells`` sets the sketch's width, a power of two; any width
    gives the same rows.
    """
    paths = stage(prefixes(turns))
    total = paths.count()
    if cells is None:
        cells = min(MOST_CELLS, 1 << max(15, (CELLS_PER_KEY * total).bit_length()))
    screened = stage(screen(paths, cells))
    some, alone = screened.where("shared").drop("shared"), screened.where("NOT shared").drop("shared")

    nodes = stage(
        some.groupBy("key").agg(
            F.count("*").alias("n_convs"), F.min(F.struct("conv_id", "length")).alias("least"), F.min("depth").alias("depth"),
            F.min("bytes").alias("last_bytes"), F.min("up").alias("up"), F.max("up_shared").alias("up_shared"),
        ).select("key", "least.*", "depth", "n_convs", "last_bytes", "up", "up_shared")
    )
    looked_up = (F.col("depth") > 1) & F.col("up_shared")
    children = (
        nodes.where(looked_up).select("up").unionByName(alone.where(looked_up).select("up"))
        .groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    )
    nodes = stage(nodes.join(children, "key", "left").fillna(0, ["n_children"]))

    # What each conversation adds where it names the node: v along its path, one for a leaf.
    saved, leaf = (F.col("n_convs") - 1) * F.col("last_bytes"), (F.col("n_children") == 0).cast("long")
    entries = stage(
        nodes.select("conv_id", "length", "depth", saved.alias("saved"), leaf.alias("leaves"))
        .unionByName(alone.where("depth = length").select(
            "conv_id", "length", "depth", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaves")))
    )
    below = running(entries, "conv_id", F.col("length") - F.col("depth"), F.col("length"), ("saved", "leaves"))
    sums = entries.groupBy("conv_id").agg(
        F.min("depth").alias("first"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"),
        F.min("length").alias("length"),
    ).where("saved + leaves > 0")
    rows = some.select("conv_id", "depth", "key")
    above = join_by_key(rows, stage(sums), "conv_id", "length", total).where("depth < first").groupBy("key").agg(
        F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves")
    )
    ends = some.where("depth = length").select("key", "conv_id")
    full = (
        nodes.join(below.select("conv_id", "depth", "saved", "leaves"), ["conv_id", "depth"])
        .join(above, "key", "left").join(digest_ends(ends), "key", "left")
        .select(
            "conv_id", "depth", "n_convs", "n_children", "up", "up_shared", "last_bytes",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )
    last = F.col("depth") == F.col("length")
    one = F.lit(1).cast("long")
    tails = alone.select(
        "conv_id", "depth", one.alias("n_convs"), (~last).cast("long").alias("n_children"), "up", "up_shared",
        F.col("bytes").alias("last_bytes"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    found = stage(full.unionByName(tails))

    top = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    over = found.where("depth = 1").agg(F.count("*").alias("n_children"))
    whole = entries.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    root_key = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("key")
    silent = digest_ends(conversations.where("length = 0").select(root_key, "conv_id")).select(
        F.col("ends_sha256").alias("silent")
    )
    first = top.first()
    # Each side is one row.
    root = top.join(over, how="left").join(whole, how="left").join(silent, how="left").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        "n_children", F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("silent", F.lit(NO_ENDS)).alias("ends_sha256"),
        F.lit(0).cast("long").alias("last_bytes"),
    )
    parents = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    asked = stage(found.where(looked_up).withColumnRenamed("n_children", "children"))
    by_parent = join_by_key(asked, parents, "up", "n_children", asked.count()).drop("n_children").withColumnRenamed("children", "n_children")
    near = found.where(~looked_up).withColumn(
        # The root's name, or the conversation's own for a parent that no other has.
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(first and first.conv_id)).otherwise(F.col("conv_id"))
    )
    return root.unionByName(by_parent.select(*root.columns)).unionByName(near.select(*root.columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie over ``conversations (conv_id, turn, role, text)``, first turns shared by family."""
    return prefix_trie(*splice(number_turns(conversations)))
