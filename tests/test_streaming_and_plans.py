import os

from pyspark.sql import functions as F

from fidelscope.operators import features, report, scoring
from fidelscope.operators.threads import with_text
from fidelscope.session import stage, staging
from fidelscope.sources.tables import MESSAGE_SCHEMA, read_messages
from fidelscope.streaming.scoring import score_stream, stream_messages, write_scored
from tests_model import small_model


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def scored_texts(spark, **cleaning):
    return scoring.score_sentences(
        spark.createDataFrame([(1, "ሰላም። x")], "id long, text string"), small_model(), **cleaning
    )


def test_scoring_is_narrow_and_without_python(spark):
    text = plan(scored_texts(spark))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_cleaning_is_evaluated_once(spark):
    for cleaning in ({}, {"compose": False}):
        assert plan(scored_texts(spark, **cleaning).where("label = 'hate'")).count("@#") == 1


def test_samples_are_limited_before_the_shuffle(spark):
    text = plan(report.label_samples(scored_texts(spark), ["id"], [F.col("sent_idx")]))
    assert text.index("row_number(), 3, Final") < text.index("Exchange") < text.index(
        "row_number(), 3, Partial")


def test_counting_terms_shuffles_nothing(spark):
    frame = spark.createDataFrame([(1, "ሰላም ቡና ሰላም"), (2, ""), (3, None), (4, "ቡና")], "id long, processed string")
    counted = features.term_freq(frame)
    assert "Exchange" not in plan(counted)
    assert sorted(map(tuple, counted.collect())) == [(1, "ሰላም", 2), (1, "ቡና", 1), (4, "ቡና", 1)]


def test_batches_are_decided_without_scoring_twice(spark):
    rows = [(1, "ጥላቻ። ቡና"), (2, "ቡና። መኪና"), (3, "ጥላቻ")]
    scored = scoring.score_sentences(spark.createDataFrame(rows, "id long, text string"), small_model())
    kept = scoring.drop_unknown_batches(scored, ["id"])
    text = plan(kept)
    assert "reflect" not in text and "UDF" not in text and "regexp_replace" not in text
    assert sorted((r.id, r.sent_idx) for r in kept.collect()) == [(1, 0), (1, 1), (3, 0)]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([(i % 3, i, None, "x") for i in range(90)], MESSAGE_SCHEMA).write.parquet(path)
    text = plan(read_messages(spark, path).where("chat_id = 2").select("message_id"))
    assert "EqualTo(chat_id,2)" in text
    assert "ReadSchema: struct<chat_id:bigint,message_id:bigint>" in text


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, i, None, t) for i, t in enumerate(
        ["ሰላም። ጥላቻ!", "x", None, "", "ስድብ ስድብ። ቡና", "ሰላም ﬁ"])]
    spark.createDataFrame(rows, MESSAGE_SCHEMA).write.parquet(source)
    query = write_scored(
        score_stream(stream_messages(spark, source), small_model()), out, str(tmp_path / "state")
    )
    query.awaitTermination(120)
    batch = scoring.score_sentences(with_text(read_messages(spark, source)), small_model())
    cols = ["message_id", "sent_idx", "processed", "label"]
    stored = spark.read.parquet(out).select(*cols).collect()
    assert stored and sorted(stored) == sorted(batch.select(*cols).collect())


def test_staged_folders_go_with_their_scope(spark, tmp_path):
    out = str(tmp_path / "out")
    with staging(spark):
        outer = stage(spark.range(5))
        with staging(spark):
            inner = stage(outer.where("id > 2"))
            inner.write.parquet(out)
            gone = inner.inputFiles()[0].removeprefix("file://")
        assert not os.path.exists(gone) and outer.count() == 5
        left = outer.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(left) and spark.read.parquet(out).count() == 2
    kept = stage(spark.range(2))
    assert kept.count() == 2
