from pyspark.sql import functions as F

from fidelscope.operators import routing

VECTORS = [
    ("https://t.me/chan", "channel_or_group", "chan", False, None, None),
    ("https://t.me/c/123", "channel_or_group", "123", True, None, None),
    ("https://t.me/c/abc", "invalid", None, False, None, "unroutable"),
    ("https://t.me/chan/12?x=1", "message", "chan", False, 12, None),
    ("https://t.me/c/12/45", "message", "12", False, 45, None),
    ("https://t.me/x/c/7", "invalid", None, False, None, "unroutable"),
    ("https://t.me/joinchat/ABC", "invalid", None, False, None, "unroutable"),
    ("https://t.me/", "invalid", None, False, None, "unroutable"),
    ("https://foot.me/x", "channel_or_group", "x", False, None, None),
    ("https://t.me//chan//#f", "channel_or_group", "chan", False, None, None),
    ("https://t.me/chan;v=1", "channel_or_group", "chan", False, None, None),
    ("https://facebook.com/x", "invalid", None, False, None, "unroutable"),
    ("https://t.me/x?u=facebook.com/", "channel_or_group", "x", False, None, "unsupported_site"),
    ("t.me/chan", "invalid", None, False, None, "bad_url"),
    ("ftp://t.me/chan", "channel_or_group", "chan", False, None, "bad_url"),
    ("http:// t.me/x", "channel_or_group", "x", False, None, "bad_url"),
    ("", "invalid", None, False, None, "empty_url"),
    (None, "invalid", None, False, None, "empty_url"),
]


def test_routes_and_errors(spark):
    rows = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VECTORS)], "i int, url string")
    got = routing.validate_requests(rows).orderBy("i").select(
        "url", "target_type", "identifier", "identifier_is_numeric", "message_id", "error_code"
    ).collect()
    assert [tuple(g) for g in got] == VECTORS


def test_strict_host(spark):
    urls = ["https://foot.me/x", "https://t.me/x", "https://www.t.me:443/x", "https://T.ME/x"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    got = routing.route_targets(rows, strict_host=True).select("target_type").collect()
    assert [g[0] for g in got] == ["invalid"] + ["channel_or_group"] * 3


def test_limits(spark):
    typed = [None, "", "abc", "0", "-5", "50", "all", "ALL", "9" * 30, "-" + "9" * 30, "+7", "1.5"]
    rows = spark.createDataFrame(list(enumerate(typed)), "i int, l string")
    got = [r[0] for r in rows.orderBy("i").select(routing.coerce_limit("l")).collect()]
    assert got == [1000, 1000, 1000, 1000, 1000, 50, None, None, 2**63 - 1, 1000, 7, 1000]


def test_chats(spark):
    chats = spark.createDataFrame(
        [(1, "News", "Channel", "", 11), (2, "talk", "Chat", "", 12), (3, "me", "User", "", None),
         (4, None, "Channel", "", None), (5, "bot", "Bot", "", None)],
        "chat_id long, username string, kind string, title string, linked_chat_id long",
    )
    urls = ["news", "c/4", "talk", "me", "bot", "nobody", "c/9", "1", "c/x"]
    rows = spark.createDataFrame(
        [(i, f"https://t.me/{u}") for i, u in enumerate(urls)], "i int, url string"
    )
    got = routing.resolve_chats(routing.route_targets(rows), chats).orderBy("i").select(
        "chat_id", "linked_chat_id", "chat_status"
    )
    assert [tuple(r) for r in got.collect()] == [
        (1, 11, "ok"), (4, None, "ok"), (2, None, "ok"), (3, None, "not_a_chat"),
        (5, None, "not_a_chat"), (None, None, "chat_not_found"), (None, None, "chat_not_found"),
        (None, None, "chat_not_found"), (None, None, None),
    ]
    assert got.where(F.col("chat_status") == "ok").count() == 3
