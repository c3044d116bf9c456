"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python and Java name for the six ASCII white-space characters that separate words.
WORD = "[^\\x20\\x09-\\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is heavy from this share of all rows on, so there are at most this many heavy keys.
HEAVY_KEYS = 1_000
#: Bits in one of Spark's bit maps.
BITMAP = 32_768


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_by_key(
    rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner"
) -> DataFrame:
    """``rows`` joined with ``groups``, one row per key, where ``size`` counts a key's rows.

    A key with at least 1/1000 of all ``total`` rows is looked up by a broadcast: there can be
    no more than 1,000 of them.  What is left has no hot key and is joined by a shuffle.  Both
    sides are split by the hashes of the hot keys, so a row passes one of the joins only.  Both
    inputs are read twice, so they should be staged.
    """
    heavy = F.col(size) * HEAVY_KEYS >= F.lit(max(total, 1))
    place = F.xxhash64(key)
    found = groups.where(heavy & F.col(key).isNotNull()).select(place.alias("place")).distinct().collect()
    if not found:
        return rows.join(groups, key, how)
    # A key that only shares its hash with a hot one is looked up too.
    hot = place.isin([r.place for r in found])
    return rows.where(hot).join(F.broadcast(groups.where(hot)), key, how).unionByName(
        rows.where(~hot).join(groups.where(~hot), key, how)
    )


def slices(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int
) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Cut record batches so that ``column`` has about ``max_bytes`` in each; never cuts a row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(binary_lengths(col)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start), start
            start = stop


def bit_map(places: DataFrame, column: str, size: int) -> np.ndarray:
    """``size`` bits as bytes, those at the places in ``column`` set; built in Spark by parts of 4 kB."""
    part = F.floor(F.col(column) / BITMAP).alias("at")
    maps = places.groupBy(part).agg(F.bitmap_construct_agg(F.col(column) % BITMAP).alias("bits"))
    bits = np.zeros(-(-size // 8), np.uint8)
    for row in maps.toLocalIterator():
        found = np.frombuffer(row.bits, np.uint8)
        start = row.at * BITMAP // 8
        bits[start : start + len(found)] = found[: len(bits) - start]
    return bits


def binary_lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, nulls as empty, and the n + 1 offsets of its rows."""
    import pyarrow.compute as pc

    col = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_texts(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` in batches bounded by bytes as well as by rows, unless the session has its
    own bound: a few very long texts then never meet in one batch."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(2**31 - 1), "2147483647b"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df.mapInArrow(function, schema)


def labelled(docs: DataFrame, label: str, parts: int = 4, held_out: int = 2) -> DataFrame:
    """``text`` and ``label`` of the rows that a model may learn from."""
    return docs.where(
        (fold(F.col("doc_id"), parts) != held_out) & F.col(label).isNotNull() & F.col("text").isNotNull()
    ).select("text", label)
