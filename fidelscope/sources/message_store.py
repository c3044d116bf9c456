"""A store of messages laid out for looking up replies and single chats.

Four tables under one folder:

* ``replies`` – replies, bucketed and sorted by the message they answer, in folders per group of
  chats.  A join with threads needs no exchange on this side.
* ``hot`` – replies of threads that hold a large share of all replies, which a bucket would keep in one
  task.  There are at most :data:`HOT_THREADS` such threads, so they are joined by broadcast.
* ``heads`` – messages that answer nothing, sorted by chat and id, in the same folders.
* ``threads`` – the keys of the hot threads.

A reader that asks for some chats reads only their folders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelscope.operators.threads import comments_of
from fidelscope.session import stage
from fidelscope.sources.tables import MESSAGE_SCHEMA

#: A thread is hot from this fraction of all replies on, so there are no more than this many.
HOT_THREADS = 1_000
CHAT_GROUPS, BUCKETS = 16, 64
PARENT = ["chat_id", "reply_to"]
COLUMNS = ["chat_id", "message_id", "reply_to", "text"]
_META = "buckets INT, chat_groups INT"


def chat_group(chat_id: Column | str, groups: int) -> Column:
    return F.pmod(F.xxhash64(chat_id), F.lit(groups)).cast("int")


@dataclass(frozen=True)
class MessageStore:
    """A store that was opened: its tables as frames."""

    replies: DataFrame
    hot: DataFrame
    heads: DataFrame
    threads: DataFrame
    chat_groups: int

    def messages(self) -> DataFrame:
        """All messages, as :func:`read_messages` gives them."""
        return self._select(lambda t: t)

    def of_chats(self, chats: DataFrame) -> DataFrame:
        """Messages of ``chats (chat_id)``, from the folders of their groups alone."""
        wanted = chats.select("chat_id").where("chat_id IS NOT NULL").distinct()
        group = chat_group("chat_id", self.chat_groups).alias("g")
        # No more values than there are folders.
        groups = [r.g for r in wanted.select(group).distinct().collect()]
        return self._select(lambda t: t.where(F.col("chat_group").isin(groups)).join(wanted, "chat_id", "left_semi"))

    def of_chat(self, chat_id: int) -> DataFrame:
        """Messages of one chat, from its folder alone."""
        return self.of_chats(self.heads.sparkSession.createDataFrame([(chat_id,)], "chat_id BIGINT"))

    def _select(self, pick: Callable[[DataFrame], DataFrame]) -> DataFrame:
        first, *rest = (pick(t).select(*COLUMNS) for t in (self.replies, self.hot, self.heads))
        for other in rest:
            first = first.unionByName(other)
        return first

    def _comments(self, threads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Comments of ``threads (chat_id, message_id, source_chat_id)``: bucketed and hot ones."""
        key = (F.col("source_chat_id") == F.col("hot_chat")) & (F.col("message_id") == F.col("hot_message"))
        hot = threads.join(
            F.broadcast(self.threads.select(
                F.col("chat_id").alias("hot_chat"), F.col("reply_to").alias("hot_message"))), key, "left_semi"
        )
        # No more rows than hot threads times the channels that share a discussion chat.
        return comments_of(threads, self.replies, keep).unionByName(comments_of(hot, self.hot, keep))

    def linked_comments(self, threads: DataFrame) -> DataFrame:
        """As :func:`threads.linked_comments`, without moving replies."""
        linked = threads.where(F.col("linked_chat_id").isNotNull())
        return self._comments(linked.withColumnRenamed("linked_chat_id", "source_chat_id"))

    def own_comments(self, threads: DataFrame) -> DataFrame:
        """As :func:`threads.own_comments`, without moving replies."""
        return self._comments(
            threads.select("chat_id", "message_id", F.col("chat_id").alias("source_chat_id"))
        )

    def comments_with_fallback(self, threads: DataFrame) -> DataFrame:
        """Linked comments, and same-chat replies only where a message has no linked comment.

        Both are looked up once; the choice is made on the keys of the linked ones.
        """
        linked = stage(self.linked_comments(threads))
        answered = linked.select("chat_id", "message_id").distinct()
        rest = threads.join(answered, ["chat_id", "message_id"], "left_anti")
        return linked.unionByName(self.own_comments(rest))


def write_messages(
    messages: DataFrame, path: str, buckets: int = BUCKETS, chat_groups: int = CHAT_GROUPS
) -> None:
    """Write ``messages`` as a store under ``path``, which must not hold one yet.

    Choose ``buckets`` so that a bucket of a group of chats fits a task.
    """
    spark = messages.sparkSession
    grouped = messages.withColumn("chat_group", chat_group("chat_id", chat_groups))
    replies = grouped.where(F.col("reply_to").isNotNull())
    sizes = stage(replies.groupBy(*PARENT).agg(F.count("*").alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hot = sizes.where((F.col("n") * HOT_THREADS >= total) & (F.col("n") >= HOT_THREADS)).select(*PARENT)
    hot = stage(hot)  # at most HOT_THREADS rows
    name = f"store_{uuid4().hex}"
    cold = replies.join(F.broadcast(hot), PARENT, "left_anti")
    try:
        (
            cold.repartition(buckets, *PARENT).write.partitionBy("chat_group").bucketBy(buckets, *PARENT)
            .sortBy(*PARENT).option("path", f"{path}/replies").format("parquet").saveAsTable(name)
        )
    finally:
        # The table is external: dropping its name leaves the files.
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    order = ["chat_group", "chat_id", "message_id"]
    for rows, table in (
        (replies.join(F.broadcast(hot), PARENT, "left_semi"), "hot"),
        (grouped.where(F.col("reply_to").isNull()), "heads"),
    ):
        near = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        near.write.partitionBy("chat_group").parquet(f"{path}/{table}")
    hot.coalesce(1).write.parquet(f"{path}/threads")
    # Written last: a store without it is incomplete.
    spark.createDataFrame([(buckets, chat_groups)], _META).coalesce(1).write.parquet(f"{path}/layout")


def open_messages(spark: SparkSession, path: str) -> MessageStore:
    """Open the store under ``path``; a missing or incomplete one is an error.

    The bucketed table is known to this session's catalog only under a name of its own.
    """
    try:
        layout = spark.read.schema(_META).parquet(f"{path}/layout").first()
    except AnalysisException as error:
        raise FileNotFoundError(f"no message store at {path}") from error
    schema = f"{MESSAGE_SCHEMA}, chat_group INT"
    name = f"replies_{uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet PARTITIONED BY (chat_group)"
        f" CLUSTERED BY (chat_id, reply_to) SORTED BY (chat_id, reply_to) INTO {layout.buckets} BUCKETS"
        f" LOCATION '{path}/replies'"
    )
    spark.sql(f"MSCK REPAIR TABLE {name}")

    def plain(table: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{table}")

    threads = spark.read.schema("chat_id BIGINT, reply_to BIGINT").parquet(f"{path}/threads")
    return MessageStore(spark.table(name), plain("hot"), plain("heads"), threads, layout.chat_groups)
