"""The message store's layout and the model store's commits."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fidelscope.operators import threads as th
from fidelscope.operators.model import TextModel
from fidelscope.sources import message_store
from fidelscope.sources.message_store import open_messages, write_messages
from fidelscope.sources.models import load_model, model_tables, save_model
from fidelscope.sources.tables import MESSAGE_SCHEMA
from tests_model import small_model

THREADS = "chat_id long, message_id long, linked_chat_id long"


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def made_messages(spark, hot=400):
    rng = random.Random(4)
    rows = [(c, i, rng.choice([None, rng.randint(0, 30)]), rng.choice(["", None, f"t{i}"]))
            for c in (1, 2, 3, 99) for i in range(60)]
    rows += [(99, 1000 + i, 5, f"h{i}") for i in range(hot)]
    rows += [(None, 1, None, "no chat"), (2, 61, 4, "x"), (2, 61, 4, "x")]
    return spark.createDataFrame(rows, MESSAGE_SCHEMA)


def made_threads(spark):
    rows = [(c, i, 99 if c != 3 else None) for c in (1, 2, 3) for i in range(0, 31, 2)] + [(1, 5, 99), (2, 5, 99)]
    return spark.createDataFrame(rows, THREADS)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "messages")
    with pytest.raises(FileNotFoundError):
        open_messages(spark, path)
    hot, message_store.HOT_THREADS = message_store.HOT_THREADS, 10
    try:
        write_messages(made_messages(spark), path, buckets=4, chat_groups=3)
    finally:
        message_store.HOT_THREADS = hot
    return open_messages(spark, path)


def test_store_gives_the_messages_back(spark, store):
    messages = made_messages(spark)
    assert rows_of(store.messages()) == rows_of(messages)
    assert store.hot.count() > 300 and store.threads.count() == 1
    some = spark.createDataFrame([(1,), (3,), (1,), (77,)], "chat_id long")
    assert rows_of(store.of_chats(some)) == rows_of(messages.where("chat_id IN (1, 3)"))
    assert rows_of(store.of_chat(99)) == rows_of(messages.where("chat_id = 99"))


def test_store_finds_the_same_comments(spark, store):
    heads, messages = made_threads(spark), made_messages(spark)
    for name in ("linked_comments", "own_comments", "comments_with_fallback"):
        assert rows_of(getattr(store, name)(heads)) == rows_of(getattr(th, name)(heads, messages)), name


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_replies_are_joined_without_an_exchange(spark, store):
    heads = made_threads(spark).select(
        "chat_id", "message_id", F.col("linked_chat_id").alias("source_chat_id")).hint("shuffle_merge")
    joined = plan(th.comments_of(heads, store.replies))
    message_side = [line for line in joined.splitlines() if "Scan parquet" in line and "reply_to" in line]
    assert len(message_side) == 1 and "Bucketed: true" in message_side[0]
    # One exchange, of the threads.
    assert joined.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in joined


def test_other_chats_are_not_read(spark, store):
    group = spark.range(1).select(message_store.chat_group(F.lit(1).cast("long"), 3)).first()[0]
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan(store.of_chat(1)))
    assert len(filters) == 3 and all(f"chat_group#" in f and f" = {group})" in f for f in filters)


def test_model_store_keeps_versions(spark, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        load_model(spark, path)
    first, second = small_model(), TextModel((0, 1), ("ሀ",), (1.0,), ((1.0,), (-1.0,)), (0.0, 0.5))
    name = save_model(spark, first, path)
    save_model(spark, second, path)
    assert load_model(spark, path) == second and load_model(spark, path, name) == first
    assert model_tables(spark, path)[1].count() == 4
    with pytest.raises(FileNotFoundError):
        load_model(spark, path, "version-none")


@pytest.mark.parametrize("broken", ["vocabulary_table", "coefficient_table"])
def test_a_failed_write_leaves_the_earlier_model(spark, tmp_path, monkeypatch, broken):
    path = str(tmp_path / "model")
    save_model(spark, small_model(), path)

    def fail(self, spark):
        return spark.range(1).select(F.raise_error(F.lit("disk full")).alias("x"))

    monkeypatch.setattr(TextModel, broken, fail)
    with pytest.raises(Exception, match="disk full"):
        save_model(spark, TextModel((0, 1), ("ሀ",), (1.0,), ((1.0,), (-1.0,)), (0.0, 0.5)), path)
    monkeypatch.undo()
    assert load_model(spark, path) == small_model()
