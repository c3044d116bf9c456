"""The analysis job: a table of requests to a report.

Requests name channels (newest messages with their comments) or posts (comments only).  The
work is shared between requests: each chat's messages are selected down to the widest limit
asked for, each thread's comments are joined once, each text is scored once.  What a request
gets is then read off by message id, because a limit keeps a run of the newest ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelscope.functions import script
from fidelscope.functions import text as tx
from fidelscope.functions.once import with_computed
from fidelscope.operators import report as rp
from fidelscope.operators import routing as rt
from fidelscope.operators import threads as th
from fidelscope.operators.linear import predict
from fidelscope.operators.model import TextModel
from fidelscope.operators.selection import asof_steps, running_sums
from fidelscope.session import stage

#: Below every message id; its negative is a number too.
_OLDEST = -(2**62)
_COUNTERS = ("sentences", *script.REPORT_LABELS)


@dataclass(frozen=True)
class Report:
    """``overview``: one row per request with status and counters; ``summary``: one row per
    request and label; ``samples``: up to three sentences per request and label.  Requests
    without a result appear in ``overview`` only."""

    overview: DataFrame
    summary: DataFrame
    samples: DataFrame


def resolve_requests(requests: DataFrame, chats: DataFrame) -> DataFrame:
    """Validate, route and resolve requests; ``target`` names what two requests can share."""
    routed = rt.validate_requests(requests).withColumn(
        "message_limit",
        F.when(F.col("target_type") == rt.CHANNEL, rt.coerce_limit("message_limit")),
    )
    target = F.concat_ws(
        ":",
        F.col("target_type"),
        F.col("chat_id").cast("string"),
        F.coalesce(F.col("message_id"), F.col("message_limit")).cast("string"),
    )
    usable = F.col("error_code").isNull() & (F.col("chat_status") == "ok")
    return rt.resolve_chats(routed, chats).withColumn("target", F.when(usable, target))


def message_keys(wanted: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of the chats asked for and their linked chats, texts cut to one character.

    That is enough to know which message has a text.  Limits, posts and comment sources are
    found on this slim table, and whole texts are read for scoring only.
    """
    chats = wanted.select(F.explode(F.array("chat_id", "linked_chat_id")).alias("chat_id"))
    return messages.select(
        *th.THREAD, "reply_to", F.substring("text", 1, 1).alias("text")
    ).join(chats.where(F.col("chat_id").isNotNull()).distinct(), "chat_id", "left_semi")


def score_threads(
    channels: DataFrame,
    posts: DataFrame,
    keys: DataFrame,
    messages: DataFrame,
    model: TextModel,
    **cleaning,
) -> DataFrame:
    """Score every text that some target needs, once.

    ``keys`` comes from :func:`message_keys`, ``channels (chat_id, linked_chat_id, floor_id)`` holds one row per chat, ``posts (chat_id,
    message_id, linked_chat_id)`` the posts.  One row per sentence, and one with a null
    ``original`` per text so that texts without a sentence still count.
    """
    widest = channels.select("chat_id", "linked_chat_id", "floor_id")

    def heads_in(table: DataFrame) -> DataFrame:
        return (
            th.with_text(table)
            .join(widest, "chat_id")
            .where(F.col("message_id") >= F.col("floor_id"))
        )

    parents = (
        heads_in(keys)
        .select(*th.THREAD, "linked_chat_id", F.lit(True).alias("in_channel"))
        .unionByName(
            posts.select(*th.THREAD, "linked_chat_id", F.lit(False).alias("in_channel"))
        )
        .groupBy(*th.THREAD, "linked_chat_id")
        .agg(F.max("in_channel").alias("in_channel"))
    )
    sources = th.comment_sources(parents, keys, keep=["in_channel"])
    texts = heads_in(messages).select(
        *th.THREAD, F.lit(True).alias("in_channel"), F.lit(None).cast("bigint").alias("comment_id"),
        "text",
    ).unionByName(
        th.comments_of(sources, messages, keep=["in_channel"]).select(
            *th.THREAD, "in_channel", "comment_id", "text"
        )
    )
    marked = F.concat(F.array(F.lit(None).cast("string")), tx.split_sentences("text"))
    sentences = texts.select(
        *th.THREAD, "in_channel", "comment_id",
        F.posexplode(marked).alias("sent_idx", "original"),
    )
    rows = with_computed(sentences, processed=tx.clean_text("original", **cleaning)).where(
        F.col("original").isNull() | (F.col("processed") != "")
    )
    scored = predict(rows, model)
    real = F.col("original").isNotNull()
    return scored.select(
        *th.THREAD, "in_channel", "comment_id", "sent_idx",
        F.substring("original", 1, script.SAMPLE_WIDTH).alias("original"),
        F.when(real, F.col("label")).alias("label"),
        (F.col("nnz") > 0).alias("known"),
    )


def _per_message(scored: DataFrame) -> DataFrame:
    """Counters per message, the message's own sentences and its comments' apart."""
    return scored.groupBy(
        *th.THREAD, "in_channel", F.col("comment_id").isNotNull().alias("is_comment")
    ).agg(
        F.count_if(F.col("original").isNull()).alias("texts"),
        F.count("label").alias("sentences"),
        *(F.count_if(F.col("label") == name).alias(name) for name in script.REPORT_LABELS),
        F.max("known").alias("known"),
    )


def _target_counts(targets: DataFrame, per_message: DataFrame) -> DataFrame:
    """Counters per target; label counters are null where nothing could be classified."""
    comment = F.col("is_comment")
    channel = targets.where(F.col("target_type") == rt.CHANNEL)
    post = targets.where(F.col("target_type") == rt.POST)
    # A chat's floors are steps: a message counts for the highest one that is not above it, found by
    # an as-of merge; a target gets the sums of its own and all newer steps.
    steps = channel.select("chat_id", "floor_id").distinct()
    totals = ("messages", "messages_with_comments", "comments", *_COUNTERS, "known")
    by_step = (
        asof_steps(per_message.where("in_channel"), steps, ["chat_id"], "message_id", "floor_id")
        .groupBy("chat_id", "floor_id")
        .agg(
            F.count_if(~comment).alias("messages"),
            F.count_if(comment).alias("messages_with_comments"),
            F.sum(F.when(comment, F.col("texts")).otherwise(0)).alias("comments"),
            *(F.sum(c).alias(c) for c in _COUNTERS),
            F.count_if("known").alias("known"),
        )
    )
    every = steps.join(by_step, ["chat_id", "floor_id"], "left").withColumn("met", F.col("messages").isNotNull().cast("int"))
    running = running_sums(every, ["chat_id"], -F.col("floor_id"), (*totals, "met"))
    in_channel = channel.select("target", "chat_id", "floor_id").join(
        running.where("met > 0"), ["chat_id", "floor_id"]
    ).select("target", *totals[:-1], (F.col("known") > 0).alias("known"))
    in_post = (
        per_message.where(comment)
        .join(post.select("target", *th.THREAD), th.THREAD)
        .select(
            "target",
            F.lit(None).cast("bigint").alias("messages"),
            F.lit(None).cast("bigint").alias("messages_with_comments"),
            F.col("texts").alias("comments"),
            *_COUNTERS,
            "known",
        )
    )
    both = in_channel.unionByName(in_post)
    return both.select(
        "target", "messages", "messages_with_comments", "comments",
        *(F.when(F.col("known"), F.col(c)).alias(c) for c in _COUNTERS),
    )


def _target_samples(targets: DataFrame, scored: DataFrame) -> DataFrame:
    """``target, label, rank, sample``.

    The newest sentences of a chat per label serve every limit: a limit only cuts off the end.
    """
    order = [
        -F.col("message_id"), F.col("comment_id").isNotNull(), -F.col("comment_id"),
        F.col("sent_idx"),
    ]
    sentences = scored.where(F.col("label").isNotNull())
    channel = targets.where(F.col("target_type") == rt.CHANNEL)
    post = targets.where(F.col("target_type") == rt.POST)
    newest = rp.label_samples(
        sentences.where("in_channel"), ["chat_id"], order, carry=["message_id"]
    )
    in_channel = newest.join(channel.select("target", "chat_id", "floor_id"), "chat_id").where(
        F.col("message_id") >= F.col("floor_id")
    )
    of_posts = sentences.where(F.col("comment_id").isNotNull()).join(
        post.select(*th.THREAD).distinct(), th.THREAD, "left_semi"
    )
    in_post = rp.label_samples(of_posts, th.THREAD, order).join(
        post.select("target", *th.THREAD), th.THREAD
    )
    cols = ["target", "label", "rank", "sample"]
    return in_channel.select(*cols).unionByName(in_post.select(*cols))


def analyze(
    requests: DataFrame, chats: DataFrame, messages: DataFrame, model: TextModel, **cleaning
) -> Report:
    """Run every request of ``requests (request_id, url, message_limit)``.

    Requests for the same target share one result.  Targets, message keys and scored sentences are
    materialised, since several outputs read them; their sizes are then known, so that joins
    broadcast the target side only while it is small.
    """
    resolved = stage(resolve_requests(requests, chats))
    wanted = resolved.where(F.col("target").isNotNull())
    shared = wanted.select(
        "target", "target_type", "chat_id", "linked_chat_id", "message_id", "message_limit"
    ).distinct()
    limits = shared.where(F.col("target_type") == rt.CHANNEL).select("chat_id", "message_limit")
    keys = stage(message_keys(wanted, messages))
    floors = th.recent_floors(keys, limits).select(
        "chat_id",
        F.col("message_limit").alias("_limit"),
        F.coalesce("floor_id", F.lit(_OLDEST)).alias("floor_id"),
    )
    targets = stage(
        shared.join(
            floors.withColumn("_type", F.lit(rt.CHANNEL)),
            (shared["chat_id"] == floors["chat_id"])
            & (shared["target_type"] == F.col("_type"))
            & shared["message_limit"].eqNullSafe(floors["_limit"]),
            "left",
        ).select(shared["*"], "floor_id")
    )
    channels = (
        targets.where(F.col("target_type") == rt.CHANNEL)
        .groupBy("chat_id", "linked_chat_id")
        .agg(F.min("floor_id").alias("floor_id"))
    )
    posts = th.find_posts(
        targets.where(F.col("target_type") == rt.POST).select(
            *th.THREAD, "linked_chat_id"
        ).distinct(),
        keys,
    )
    scored = stage(score_threads(channels, posts, keys, messages, model, **cleaning))
    counts = stage(_target_counts(targets, _per_message(scored)))
    samples = stage(_target_samples(targets, scored))

    # Failed requests have no target and nothing to look up.
    failed = resolved.where(F.col("target").isNull())
    joined = wanted.join(counts, "target", "left").unionByName(failed, allowMissingColumns=True)
    overview = joined.select(
        "request_id", "url", "target_type",
        rp.request_status().alias("status"),
        "messages", "messages_with_comments", "comments", "sentences",
    )
    answered = joined.where(F.col("sentences") > 0)
    summary = rp.unfold_counts(answered, ["request_id"])
    shown = answered.select("request_id", "target").join(samples, "target").select(
        "request_id", "label", "rank", "sample"
    )
    return Report(overview, summary, shown)
