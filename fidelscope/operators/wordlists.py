"""Stopword lists too large for a literal: tables of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_listed_tokens(
    df: DataFrame, words: DataFrame, key: str = "id", column: str = "tokens", word: str = "word"
) -> DataFrame:
    """``key, column`` with the tokens that ``words (word)`` lists removed, in their order.

    ``column`` is an array of tokens and ``key`` unique; every row stays, a null array as an empty one.
    Matches are exact, as in the literal form.  Tokens travel with their position: the list is broadcast
    while it is small and shuffled by word beyond that (a frequent token's rows are then split by
    the adaptive skew join), and each text is put together again from what is left.
    """
    # A null in front stands for the row itself: it equals no word.
    front = F.array(F.lit(None).cast("string"))
    tokens = F.coalesce(column, F.array().cast("array<string>"))
    placed = df.select(key, F.posexplode(F.concat(front, tokens)).alias("place", "token"))
    listed = words.select(F.col(word).alias("token")).where("token IS NOT NULL").distinct()
    left = placed.join(listed, "token", "left_anti")
    kept = F.sort_array(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "token"))))
    return left.groupBy(key).agg(kept["token"].alias(column))
