"""Messages, their comments, and the texts of a thread.

Message ids grow with time inside a chat and are unique there, so they give both the order of a
chat and an even way to cut it: all blocks below are ranges of ids.  With the 32-bit ids of
chat exports a chat has at most 32,768 blocks, and a block at most ``ID_BLOCK`` messages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelscope.operators.selection import rank_cutoffs
from fidelscope.session import stage

ID_BLOCK = 65_536
#: Comments of a message in one array at least, before another part begins.
PART_SIZE = 65_536
#: Comments are counted by ranges of so many ids.
ID_SPAN = 4_096
THREAD = ["chat_id", "message_id"]


def with_text(messages: DataFrame) -> DataFrame:
    """Messages with a text and an id other than 0."""
    return messages.where((F.col("text") != "") & (F.col("message_id") != 0))


def recent_floors(messages: DataFrame, limits: DataFrame) -> DataFrame:
    """``chat_id, message_limit, floor_id`` for each row of ``limits (chat_id, message_limit)``.

    ``floor_id`` is the oldest message id among the newest ``message_limit`` messages; null when
    the limit is null or the chat is shorter.  Counts all messages, with or without text, and
    reads ids only.
    """
    newest_first = messages.select(
        "chat_id",
        (-F.col("message_id")).alias("order"),
        F.floor(-F.col("message_id") / F.lit(ID_BLOCK)).alias("bucket"),
    )
    takes = limits.where(F.col("message_limit").isNotNull()).select(
        "chat_id", F.col("message_limit").alias("take")
    ).distinct()
    floors = rank_cutoffs(
        newest_first.join(takes.select("chat_id").distinct(), "chat_id", "left_semi"),
        takes,
        ["chat_id"],
    ).select("chat_id", F.col("take").alias("message_limit"), (-F.col("cutoff")).alias("floor_id"))
    unlimited = limits.where(F.col("message_limit").isNull()).distinct().withColumn(
        "floor_id", F.lit(None).cast("bigint")
    )
    return floors.unionByName(unlimited)


def recent_messages(messages: DataFrame, limit: int | None) -> DataFrame:
    """The newest ``limit`` messages of every chat, all for ``None``.  No text is shuffled."""
    if limit is None:
        return messages
    limits = messages.select("chat_id").distinct().withColumn(
        "message_limit", F.lit(limit).cast("bigint")
    )
    floors = recent_floors(messages, limits).where(F.col("floor_id").isNotNull())
    return (
        messages.join(floors.select("chat_id", "floor_id"), "chat_id", "left")
        .where(F.col("floor_id").isNull() | (F.col("message_id") >= F.col("floor_id")))
        .drop("floor_id")
    )


def find_posts(targets: DataFrame, messages: DataFrame) -> DataFrame:
    """Targets (with ``chat_id, message_id``) whose message exists.

    The target keys reduce the messages first, so the large side is not shuffled while the
    targets are few.
    """
    found = messages.select(*THREAD).join(targets.select(*THREAD).distinct(), THREAD, "left_semi")
    return targets.join(found.distinct(), THREAD, "left_semi")


def _replies(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("reply_to").isNotNull() & (F.col("text") != "")).select(
        F.col("chat_id").alias("source_chat_id"),
        "reply_to",
        F.col("message_id").alias("comment_id"),
        "text",
    )


def comments_of(threads: DataFrame, messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Replies to ``threads (chat_id, message_id, source_chat_id)`` found in the source chat.

    Hot threads: the replies' side is split by the adaptive skew join.
    """
    parents = threads.select(
        "source_chat_id", F.col("message_id").alias("reply_to"), "chat_id", *keep
    )
    return _replies(messages).join(parents, ["source_chat_id", "reply_to"]).select(
        "chat_id",
        F.col("reply_to").alias("message_id"),
        *keep,
        "source_chat_id",
        "comment_id",
        "text",
    )


def linked_comments(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Comments in the linked discussion chat of ``threads (chat_id, message_id, linked_chat_id)``."""
    linked = threads.where(F.col("linked_chat_id").isNotNull())
    return comments_of(linked.withColumnRenamed("linked_chat_id", "source_chat_id"), messages)


def own_comments(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Replies in the chat of the message itself."""
    return comments_of(
        threads.select(*THREAD, F.col("chat_id").alias("source_chat_id")), messages
    )


def comment_sources(
    threads: DataFrame, messages: DataFrame, keep: Sequence[str] = ()
) -> DataFrame:
    """Add ``source_chat_id``: the linked chat where it has a comment, else the own chat."""
    linked = threads.where(F.col("linked_chat_id").isNotNull()).select(
        F.col("linked_chat_id").alias("source_chat_id"), F.col("message_id").alias("reply_to")
    )
    answered = (
        _replies(messages)
        .select("source_chat_id", "reply_to")
        .join(linked.distinct(), ["source_chat_id", "reply_to"], "left_semi")
        .distinct()
        .select(
            F.col("source_chat_id").alias("linked_chat_id"),
            F.col("reply_to").alias("message_id"),
            F.lit(True).alias("answered"),
        )
    )
    return threads.join(answered, ["linked_chat_id", "message_id"], "left").select(
        *THREAD,
        *keep,
        F.when(F.col("answered"), F.col("linked_chat_id"))
        .otherwise(F.col("chat_id"))
        .alias("source_chat_id"),
    )


def comments_with_fallback(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Linked comments, and same-chat replies only where a message has no linked comment.

    The source is chosen from keys alone; comment texts then move in a single join.
    """
    return comments_of(comment_sources(threads, messages), messages)


def attach_comments(
    messages: DataFrame, comments: DataFrame, part_size: int = PART_SIZE, span: int = ID_SPAN
) -> DataFrame:
    """Messages with their comments, newest first: ``…, part, start, comments ARRAY<STRING>``.

    One row per message, unless it has more than ``part_size`` comments: then there are parts, cut
    between ranges of ``span`` ids wherever another ``part_size`` comments have come together, so
    that none outgrows a task.  ``start`` counts the comments in earlier parts.  Part 0 always
    exists, with an empty array where there is no comment.

    Comments are read once: their arrays per range are written, the ranges numbered by their counts
    alone, and the arrays put together by part.
    """
    newest_first = F.sort_array(F.collect_list(F.struct("comment_id", "text")), asc=False)
    blocks = stage(
        comments.groupBy(*THREAD, F.floor(F.col("comment_id") / F.lit(span)).alias("block")).agg(
            F.count("*").alias("n"), newest_first["text"].alias("texts")
        )
    )
    earlier = Window.partitionBy(*THREAD).orderBy(F.desc("block"))
    counted = blocks.select(
        *THREAD, "block", (F.sum("n").over(earlier) - F.col("n")).alias("start")
    )
    portion = Window.partitionBy(*THREAD).orderBy(F.floor(F.col("start") / F.lit(part_size)))
    numbered = counted.withColumn("part", (F.dense_rank().over(portion) - 1).cast("bigint"))
    pieces = F.sort_array(F.collect_list(F.struct("block", "texts")), asc=False)
    arrays = (
        blocks.join(numbered, [*THREAD, "block"])
        .groupBy(*THREAD, "part")
        .agg(F.min("start").alias("start"), F.flatten(pieces["texts"]).alias("comments"))
    )
    heads = messages.select(*THREAD, F.col("text").alias("message_text"))
    none = F.lit(0).cast("bigint")
    return heads.join(arrays, THREAD, "left").select(
        *THREAD,
        "message_text",
        F.coalesce("part", none).alias("part"),
        F.coalesce("start", none).alias("start"),
        F.coalesce("comments", F.array().cast("array<string>")).alias("comments"),
    )


def thread_stats(threads: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Messages, messages with a comment, and comments per group (default: per chat)."""
    first = F.col("part") == 0
    return threads.groupBy(*(group or ["chat_id"])).agg(
        F.count_if(first).alias("messages"),
        F.count_if(first & (F.size("comments") > 0)).alias("messages_with_comments"),
        F.sum(F.size("comments")).cast("bigint").alias("comments"),
    )


def flatten_texts(threads: DataFrame) -> DataFrame:
    """``chat_id, message_id, text_idx, text``: the message at 0, then its comments."""
    first = F.col("part") == 0
    head = F.when(first, F.array("message_text")).otherwise(F.array().cast("array<string>"))
    offset = F.when(first, F.lit(0)).otherwise(F.col("start") + 1)
    return threads.select(
        *THREAD, offset.alias("offset"), F.posexplode(F.concat(head, "comments")).alias("pos", "text")
    ).select(*THREAD, (F.col("offset") + F.col("pos")).cast("bigint").alias("text_idx"), "text")


def post_texts(posts: DataFrame, messages: DataFrame) -> DataFrame:
    """Comments of posts in scoring form; the post's own text is not among them."""
    return comments_with_fallback(find_posts(posts, messages), messages).select(
        *THREAD, "comment_id", "text"
    )
