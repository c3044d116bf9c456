"""Requests: validation, routing to a chat or post, limit coercion, chat resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelscope.functions import script, urls
from fidelscope.functions.once import with_computed

HOSTS = ("t.me", "telegram.me")
CHANNEL, POST, INVALID = "channel_or_group", "message", "invalid"
_INTEGER = r"^[+-]?[0-9]+$"
_MAX_LONG = 2**63 - 1


def _parse_long(col: Column) -> Column:
    return F.when(col.rlike(_INTEGER), col.try_cast("bigint"))


def route_targets(requests: DataFrame, strict_host: bool = False) -> DataFrame:
    """Add ``target_type, identifier, identifier_is_numeric, message_id`` from ``url``.

    The host test is a substring test; ``strict_host`` asks for the host itself (or ``www.``).
    Integers are ASCII digits with an optional sign, within BIGINT.
    """
    seg, authority = F.col("_segments"), F.col("_authority")
    if strict_host:
        known_host = F.regexp_replace(F.lower(authority), r"^www\.|:\d+$", "").isin(*HOSTS)
    else:
        known_host = authority.contains(HOSTS[0]) | authority.contains(HOSTS[1])
    n = F.size(seg)
    first, last, before_last = (F.try_element_at(seg, F.lit(i)) for i in (1, -1, -2))
    number = _parse_long(last)
    short_id = (n == 2) & (first == "c")
    kind = (
        F.when(~known_host | (n == 0), F.lit(INVALID))
        .when(n == 1, F.lit(CHANNEL))
        .when(short_id & number.isNotNull(), F.lit(CHANNEL))
        .when(number.isNotNull() & (before_last != "c"), F.lit(POST))
        .otherwise(F.lit(INVALID))
    )
    kind = F.coalesce(kind, F.lit(INVALID))
    parts = with_computed(
        requests, _authority=urls.url_authority("url"), _segments=urls.url_segments("url")
    )
    routed = parts.withColumn("target_type", kind)
    is_channel, is_post = F.col("target_type") == CHANNEL, F.col("target_type") == POST
    return (
        routed.withColumn(
            "identifier",
            F.when(is_channel & short_id, number.cast("string"))
            .when(is_channel, last)
            .when(is_post, before_last),
        )
        .withColumn("identifier_is_numeric", is_channel & short_id)
        .withColumn("message_id", F.when(is_post, number))
        .drop("_authority", "_segments")
    )


def validate_requests(requests: DataFrame, strict_host: bool = False) -> DataFrame:
    """Add the routing columns and ``error_code``: the first rule a request breaks, else null.

    In order: ``empty_url``, ``bad_url`` (no http prefix), ``unroutable``, ``unsupported_site``.
    """
    url = F.col("url")
    code = (
        F.when(url.isNull() | (url == ""), "empty_url")
        .when(~url.rlike(rf"^https?://[^{script.WHITE_SPACE}]"), "bad_url")
        .when(F.col("target_type") == INVALID, "unroutable")
        .when(url.contains("facebook.com/"), "unsupported_site")
    )
    return route_targets(requests, strict_host).withColumn("error_code", code)


def coerce_limit(col: Column | str, default: int = script.DEFAULT_MESSAGE_LIMIT) -> Column:
    """Message limit as BIGINT; null means unlimited (``all``), bad or missing values the default."""
    typed = F.col(col) if isinstance(col, str) else col
    value = F.when(
        typed.rlike(_INTEGER),
        F.coalesce(
            typed.try_cast("bigint"),
            F.when(typed.startswith("-"), F.lit(0)).otherwise(F.lit(_MAX_LONG)),
        ),
    )
    return (
        F.when(F.lower(typed) == "all", F.lit(None).cast("bigint"))
        .when(value > 0, value)
        .otherwise(F.lit(default).cast("bigint"))
    )


def resolve_chats(targets: DataFrame, chats: DataFrame) -> DataFrame:
    """Find the chat of each target: adds ``chat_id, kind, linked_chat_id, chat_status``.

    Numeric identifiers match ``chat_id``, names match ``username`` regardless of case.
    ``chat_status`` is ``ok``, ``chat_not_found``, or ``not_a_chat`` for users and other kinds.
    ``linked_chat_id`` is kept for channels only.  The join is one equi-join, which Spark
    broadcasts where the chat table is small.
    """
    cols = ["chat_id", "kind", "linked_chat_id"]
    by_id = chats.select(F.col("chat_id").cast("string").alias("_name"), F.lit(True).alias("_num"),
                         *cols)
    by_name = chats.where(F.col("username").isNotNull()).select(
        F.lower("username").alias("_name"), F.lit(False).alias("_num"), *cols
    )
    known = by_id.unionByName(by_name)
    joined = targets.join(
        known,
        (F.lower(targets["identifier"]) == known["_name"])
        & (targets["identifier_is_numeric"] == known["_num"]),
        "left",
    ).drop("_name", "_num")
    status = (
        F.when(F.col("identifier").isNull(), F.lit(None).cast("string"))
        .when(F.col("chat_id").isNull(), "chat_not_found")
        .when(F.col("kind").isin("Channel", "Chat"), "ok")
        .otherwise("not_a_chat")
    )
    linked = F.when(F.col("kind") == "Channel", F.col("linked_chat_id"))
    return joined.withColumn("chat_status", status).withColumn("linked_chat_id", linked)
