import random

from pyspark.sql import functions as F

from fidelscope.operators import threads
from fidelscope.operators.selection import asof_steps, rank_cutoffs, running_sums

MESSAGES = "chat_id long, message_id long, reply_to long, text string"
THREADS = "chat_id long, message_id long, linked_chat_id long, text string"


def as_set(frame, *cols):
    return {tuple(r) for r in frame.select(*cols).collect()}


def test_rank_cutoffs_against_sorting(spark):
    rng = random.Random(5)
    # One key holds most rows, ids are uneven, takes go beyond the rows.
    rows = {(rng.choice([1] * 8 + [2, 3]), rng.choice([rng.randint(0, 50), rng.randint(0, 10**6)]))
            for _ in range(3000)}
    takes = [(k, t) for k in (1, 2, 3, 9) for t in (1, 7, 100, 2000, 5000)]
    frame = spark.createDataFrame(sorted(rows), "k long, order long").withColumn(
        "bucket", F.floor(F.col("order") / 64)
    )
    got = rank_cutoffs(frame, spark.createDataFrame(takes, "k long, take long"), ["k"])
    expected = set()
    for k, t in takes:
        mine = sorted(o for key, o in rows if key == k)
        expected.add((k, t, mine[t - 1] if len(mine) >= t else None))
    assert as_set(got, "k", "take", "cutoff") == expected


def test_recent_counts_empty_messages_too(spark):
    rows = [(1, i, None, "" if i % 2 else f"t{i}") for i in range(10)] + [(2, 5, None, "x")]
    messages = spark.createDataFrame(rows, MESSAGES)
    recent = threads.recent_messages(messages, 4)
    assert as_set(recent, "chat_id", "message_id") == {(1, 9), (1, 8), (1, 7), (1, 6), (2, 5)}
    assert as_set(threads.with_text(recent), "chat_id", "message_id") == {(1, 8), (1, 6), (2, 5)}
    assert threads.recent_messages(messages, None).count() == 11


def test_text_filter_drops_id_zero_and_null(spark):
    rows = [(1, 0, None, "x"), (1, 1, None, None), (1, 2, None, ""), (1, 3, None, "y")]
    kept = threads.with_text(spark.createDataFrame(rows, MESSAGES))
    assert as_set(kept, "message_id") == {(3,)}


def fallback_case(spark):
    heads = spark.createDataFrame(
        [(1, 10, 99, "a"), (1, 20, 99, "b"), (1, 30, 99, "c"), (2, 10, None, "d")], THREADS
    )
    messages = spark.createDataFrame(
        [
            (99, 500, 10, "linked"), (1, 11, 10, "own, unused"),
            (99, 501, 20, ""), (1, 21, 20, "own, used"),  # a blank linked comment does not count
            (2, 12, 10, "late"), (2, 11, 10, "early"), (2, 13, 10, None), (3, 1, 10, "elsewhere"),
        ],
        MESSAGES,
    )
    return heads, messages


def test_fallback_only_without_linked_comment(spark):
    got = threads.comments_with_fallback(*fallback_case(spark))
    assert as_set(got, "chat_id", "message_id", "text") == {
        (1, 10, "linked"), (1, 20, "own, used"), (2, 10, "late"), (2, 10, "early"),
    }


def test_nesting_and_flattening(spark):
    heads, messages = fallback_case(spark)
    nested = threads.attach_comments(heads, threads.comments_with_fallback(heads, messages))
    assert {tuple([*r[:2], tuple(r[2])]) for r in
            nested.select("chat_id", "message_id", "comments").collect()} == {
        (1, 10, ("linked",)), (1, 20, ("own, used",)), (1, 30, ()), (2, 10, ("late", "early")),
    }
    assert as_set(threads.flatten_texts(nested), "chat_id", "message_id", "text_idx", "text") == {
        (1, 10, 0, "a"), (1, 10, 1, "linked"), (1, 20, 0, "b"), (1, 20, 1, "own, used"),
        (1, 30, 0, "c"), (2, 10, 0, "d"), (2, 10, 1, "late"), (2, 10, 2, "early"),
    }
    assert as_set(threads.thread_stats(nested), "chat_id", "messages", "messages_with_comments",
                  "comments") == {(1, 3, 2, 2), (2, 1, 1, 2)}


def test_hot_thread_is_whole_and_in_order(spark):
    n = 5000
    heads = spark.createDataFrame([(1, 1, None, "head")], THREADS)
    messages = spark.range(2, n + 2).select(
        F.lit(1).cast("long").alias("chat_id"), (F.col("id") * 3).alias("message_id"),
        F.lit(1).cast("long").alias("reply_to"), F.col("id").cast("string").alias("text"),
    )
    nested = threads.attach_comments(heads, threads.own_comments(heads, messages), part_size=1, span=100)
    assert nested.agg(F.max(F.size("comments"))).first()[0] <= 100
    flat = threads.flatten_texts(nested).orderBy("text_idx").collect()
    assert [r.text_idx for r in flat] == list(range(n + 1))
    assert [r.text for r in flat] == ["head"] + [str(i) for i in range(n + 1, 1, -1)]
    stats = threads.thread_stats(nested).first()
    assert (stats.messages, stats.messages_with_comments, stats.comments) == (1, 1, n)


def test_posts(spark):
    heads, messages = fallback_case(spark)
    targets = spark.createDataFrame([(1, 11, None), (1, 77, None), (2, 12, None)],
                                    "chat_id long, message_id long, linked_chat_id long")
    assert as_set(threads.find_posts(targets, messages), "chat_id", "message_id") == {(1, 11), (2, 12)}
    both = messages.unionByName(heads.select("chat_id", "message_id",
                                             F.lit(None).cast("long").alias("reply_to"), "text"))
    posts = heads.select("chat_id", "message_id", "linked_chat_id")
    assert as_set(threads.post_texts(posts, both), "chat_id", "message_id", "text") == {
        (1, 10, "linked"), (1, 20, "own, used"), (2, 10, "late"), (2, 10, "early"),
    }


def test_asof_steps_and_running_sums_against_sorting(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(-200, 3000), i) for i in range(2000)]
    steps = {(k, rng.choice([rng.randint(-100, 3000), 10**9, -(2**62)])) for k in (1, 1, 1, 4, 2) for _ in range(40)}
    got = asof_steps(
        spark.createDataFrame(rows, "k long, at long, n long"),
        spark.createDataFrame([(k, s, f"{k}/{s}") for k, s in steps], "k long, step long, name string"),
        ["k"], "at", "step", span=64,
    )
    expected = set()
    for k, at, n in rows:
        below = [s for key, s in steps if key == k and s <= at]
        if below:
            expected.add((k, at, n, max(below), f"{k}/{max(below)}"))
    assert as_set(got, "k", "at", "n", "step", "name") == expected
    unique = {(k, at): n for k, at, n in rows}
    summed = running_sums(
        spark.createDataFrame([(k, at, n if n % 3 else None) for (k, at), n in unique.items()], "k long, at long, n long"),
        ["k"], -F.col("at"), ["n"], span=64)
    assert as_set(summed, "k", "at", "n") == {
        (k, at, sum(m for (key, other), m in unique.items() if key == k and other >= at and m % 3)) for k, at in unique}


def test_a_hundred_thousand_limits_on_one_chat(spark):
    n = 100_000
    messages = spark.range(n).select(
        F.lit(1).cast("long").alias("chat_id"), (F.col("id") * 3).alias("message_id"),
        F.lit(None).cast("long").alias("reply_to"), F.lit("").alias("text"),
    )
    limits = spark.range(1, n + 2).select(F.lit(1).cast("long").alias("chat_id"), F.col("id").alias("message_limit"))
    floors = threads.recent_floors(messages, limits)
    wrong = floors.where(~F.col("floor_id").eqNullSafe(
        F.when(F.col("message_limit") <= n, (n - F.col("message_limit")) * 3)))
    assert floors.count() == n + 1 and wrong.count() == 0
