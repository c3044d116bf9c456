"""Exact deduplication: groups, the persistent index, odd rows."""

from __future__ import annotations

from hashlib import sha256

from fidelscope.llm.exact_dedup import DigestIndex, deduplicate, drop_copies

SCHEMA = "doc_id BIGINT, text STRING, digest STRING, row STRING"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", str(n)) for n, (i, t) in enumerate(rows)], SCHEMA).coalesce(1)


def test_largest_id_stays_and_null_is_empty(spark):
    docs = rows_of(spark, [(1, "a"), (5, "a"), (3, None), (4, ""), (2, "é"), (None, "a"), (None, "b")])
    got = {(r.doc_id, r.row): r for r in deduplicate(docs).rows.collect()}
    assert [(k[0], r.keep_id, r.group_size, r.kept) for k, r in sorted(got.items(), key=lambda x: x[0][1])] == [
        (1, 5, 3, False), (5, 5, 3, True), (3, 4, 2, False), (4, 4, 2, True), (2, 2, 1, True),
        (None, 5, 3, False), (None, None, 1, True)]
    assert {r.digest for k, r in got.items() if k[0] == 2} == {sha256("é".encode()).hexdigest()}


def test_repeated_rows_keep_one(spark):
    docs = rows_of(spark, [(7, "x")] * 5 + [(8, "y")])
    assert sorted((r.doc_id, r.kept) for r in deduplicate(docs).rows.collect()) == [(7, False)] * 4 + [(7, True), (8, True)]
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [7, 8]


def test_index_persists_and_is_joined_without_an_exchange(spark):
    index = DigestIndex(spark, buckets=4)
    deduplicate(rows_of(spark, [(1, "a"), (2, "b")]), index)
    index.close()
    again = DigestIndex(spark, index.path, buckets=4)
    got = deduplicate(rows_of(spark, [(10, "b"), (11, "b"), (12, "c")]), again).rows.collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [
        (10, 2, 2, False), (11, 2, 2, False), (12, 12, 1, True)]
    assert again.frame().count() == 3
    groups = spark.createDataFrame([("d",)], "digest STRING").groupBy("digest").count()
    plan = again.unseen(groups)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_empty_table(spark):
    assert deduplicate(rows_of(spark, [(1, "a")]).limit(0)).rows.count() == 0
