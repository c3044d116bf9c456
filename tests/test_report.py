from pyspark.sql import functions as F

from fidelscope.operators import report, scoring
from tests_model import small_model

SCORED = "r int, sent_idx int, label string, original string"


def test_shares(spark):
    rows = [(1, i, l, "x") for i, l in enumerate(["hate", "normal", "normal", "normal"])]
    rows += [(2, 0, "unknown", "x"), (2, 1, "hate", "x")]
    got = report.label_summary(spark.createDataFrame(rows, SCORED), ["r"])
    assert [tuple(r) for r in got.orderBy("r", "position").select(
        "r", "label", "count", "percentage", "percentage_text").collect()] == [
        (1, "hate", 1, 25.0, "25.00%"), (1, "offensive", 0, 0.0, "0.00%"),
        (1, "normal", 3, 75.0, "75.00%"),
        (2, "hate", 1, 50.0, "50.00%"), (2, "offensive", 0, 0.0, "0.00%"),
        (2, "normal", 0, 0.0, "0.00%"),
    ]


def test_percentage_text_of_all_small_ratios(spark):
    pairs = [(c, n) for n in range(1, 400, 7) for c in range(n + 1)] + [(1, 800), (107, 4000)]
    frame = spark.createDataFrame(pairs, "c long, n long")
    from fidelscope.functions.labels import percentage, percentage_text

    share = percentage(F.col("c"), F.col("n"))
    for r in frame.select("c", "n", percentage_text(share).alias("t")).collect():
        assert r.t == f"{r.c / r.n * 100:.2f}%"


def test_samples(spark):
    rows = [(1, i, "normal", f"{i}" * 300) for i in range(5)]
    rows += [(1, 9, "hate", "short"), (1, 3, "unknown", "x")]
    got = report.label_samples(spark.createDataFrame(rows, SCORED), ["r"], [F.col("sent_idx")])
    assert {tuple(r) for r in got.select("label", "rank", "sample").collect()} == {
        ("normal", i + 1, f"{i}" * 200 + "...") for i in range(3)
    } | {("hate", 1, "short...")}


def test_unknown_batches(spark):
    texts = spark.createDataFrame(
        [(1, "ቡና። መኪና።"), (2, "ቡና። ጥላቻ።"), (3, None), (4, "latin.")], "r int, text string"
    )
    scored = scoring.score_sentences(texts, small_model())
    assert scored.count() == 4
    kept = scoring.drop_unknown_batches(scored, ["r"])
    assert {tuple(r) for r in kept.select("r", "original", "label").collect()} == {
        (2, "ቡና።", "normal"), (2, "ጥላቻ።", "hate")}


def test_status_order(spark):
    cols = "error_code string, chat_status string, target_type string, messages long, comments long, sentences long"
    cases = [
        ("bad_url", "ok", "message", 1, 1, 1, "bad_url"),
        (None, "not_a_chat", "message", 1, 1, 1, "not_a_chat"),
        (None, "ok", "channel_or_group", None, None, None, "no_content"),
        (None, "ok", "channel_or_group", 3, 0, None, "nothing_classified"),
        (None, "ok", "message", None, None, None, "no_comments"),
        (None, "ok", "message", None, 2, None, "nothing_classified"),
        (None, "ok", "message", None, 2, 5, "ok"),
        (None, "ok", "channel_or_group", 3, 0, 5, "ok"),
    ]
    frame = spark.createDataFrame([c[:-1] for c in cases], cols)
    assert [r[0] for r in frame.select(report.request_status()).collect()] == [c[-1] for c in cases]
