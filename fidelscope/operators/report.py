"""Report tables: label shares, sample sentences, counters and status per request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelscope.functions import labels as lb
from fidelscope.functions import script
from fidelscope.operators.routing import CHANNEL, POST


def label_counts(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """``group, sentences`` and one counter column per reported label."""
    return scored.groupBy(*group).agg(
        F.count("label").alias("sentences"),
        *(F.count_if(F.col("label") == name).alias(name) for name in script.REPORT_LABELS),
    )


def unfold_counts(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Turn the counter columns into one row per label with its share of all sentences."""
    rows = F.array(
        *(
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("label"),
                     F.col(name).alias("count"))
            for i, name in enumerate(script.REPORT_LABELS)
        )
    )
    share = lb.percentage(F.col("count"), F.col("sentences"))
    return (
        counts.select(*group, "sentences", F.inline(rows))
        .withColumn("percentage", share)
        .withColumn("percentage_text", lb.percentage_text("percentage"))
        .drop("sentences")
    )


def label_summary(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """``position, label, count, percentage, percentage_text`` for every reported label.

    Absent labels count 0; sentences with an unknown label are part of the total.
    """
    return unfold_counts(label_counts(scored, group), group)


def sample_text(col: Column | str) -> Column:
    """The first 200 characters, always followed by an ellipsis."""
    return F.concat(F.substring(col, 1, script.SAMPLE_WIDTH), F.lit("..."))


def label_samples(
    scored: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int = script.SAMPLES_PER_LABEL,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``group, label, rank, sample`` and ``carry``: the first ``k`` sentences per label in input order.

    Sentences are cut before they move, and the literal bound lets every task keep ``k`` rows
    per label before the shuffle.
    """
    names = [f"_order{i}" for i in range(len(order))]
    cut = scored.where(F.col("label").isin(*script.REPORT_LABELS)).select(
        *group, *carry, "label", sample_text("original").alias("sample"),
        *(c.alias(n) for c, n in zip(order, names, strict=True)),
    )
    place = Window.partitionBy(*group, "label").orderBy(*names)
    return (
        cut.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select(*group, *carry, "label", F.col("rank").cast("bigint").alias("rank"), "sample")
    )


def channel_summary(stats: DataFrame, counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Messages, messages with comments, comments and classified sentences per channel target."""
    return stats.join(counts.select(*group, "sentences"), list(group), "left").select(
        *group, "messages", "messages_with_comments", "comments",
        F.coalesce("sentences", F.lit(0).cast("bigint")).alias("sentences"),
    )


def post_summary(comments: DataFrame, counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Comments retrieved and classified sentences per post target."""
    found = comments.groupBy(*group).agg(F.count("*").alias("comments"))
    return found.join(counts.select(*group, "sentences"), list(group), "left").select(
        *group, "comments", F.coalesce("sentences", F.lit(0).cast("bigint")).alias("sentences")
    )


def request_status(
    error_code: Column | str = "error_code",
    chat_status: Column | str = "chat_status",
    target_type: Column | str = "target_type",
    messages: Column | str = "messages",
    comments: Column | str = "comments",
    sentences: Column | str = "sentences",
) -> Column:
    """What became of a request: the request's error, the chat's error, or the first of
    ``no_content``, ``no_comments``, ``nothing_classified``, ``ok`` that applies."""

    def at(value: Column | str) -> Column:
        return F.col(value) if isinstance(value, str) else value

    def none(value: Column | str) -> Column:
        return F.coalesce(at(value), F.lit(0)) == 0

    return (
        F.when(at(error_code).isNotNull(), at(error_code))
        .when(at(chat_status) != "ok", at(chat_status))
        .when((at(target_type) == CHANNEL) & none(messages), "no_content")
        .when((at(target_type) == POST) & none(comments), "no_comments")
        .when(none(sentences), "nothing_classified")
        .otherwise("ok")
    )
