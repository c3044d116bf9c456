import math
import re
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fidelscope.functions.labels import label_name
from fidelscope.operators import corpus, features, linear, logistic, metrics
from tests_model import small_model
from fidelscope.plans.training import TrainingConfig, train

WORDS = ["ሰላም", "ጥላቻ", "ስድብ", "አገር", "ዜና", "ቡና", "መኪና", "ትምህርት", "ወንዝ", "ተራራ"]


def texts(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 0, 1, 2])
        own = [WORDS[label]] * rng.randint(0, 3)
        rows.append((i, " ".join(own + rng.choices(WORDS[3:], k=rng.randint(1, 6))), str(label)))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(texts(300), "id long, text string, label string")


def test_quotas():
    assert corpus.split_quotas({0: 299, 1: 51, 2: 49}) == {0: 60, 1: 10, 2: 10}
    assert corpus.split_quotas({0: 5}) == {0: 1}
    for sizes in ({0: 7, 1: 3}, {0: 1, 1: 1, 2: 1}, {0: 1000, 1: 1}):
        assert sum(corpus.split_quotas(sizes).values()) == math.ceil(sum(sizes.values()) / 5)


def test_split_is_exact_and_stable(spark, labelled):
    def test_ids(frame):
        return {r.id for r in corpus.stratified_split(frame).where("part = 'test'").collect()}

    first = test_ids(labelled)
    assert len(first) == 60 and first == test_ids(labelled.repartition(5))
    sizes = {int(r.label): r["count"] for r in labelled.groupBy("label").count().collect()}
    split = corpus.stratified_split(labelled).where("part = 'test'")
    shares = {int(r.label): r["count"] for r in split.groupBy("label").count().collect()}
    assert shares == corpus.split_quotas(sizes)
    assert first != {r.id for r in corpus.stratified_split(labelled, seed=7)
                     .where("part = 'test'").collect()}


def test_label_coercion(spark):
    def coerce(values):
        frame = spark.createDataFrame([(v,) for v in values], "label string")
        return [r.label for r in corpus.coerce_labels(frame).collect()]

    assert coerce(["0", "2", "7"]) == [0, 2, 7]
    assert coerce(["hate", "normal", "offensive"]) == [1, 0, 2]
    for bad in (["0", "hate"], ["hate", "rude"], ["0", None], ["0.5", "1"]):
        with pytest.raises(ValueError, match="labels"):
            coerce(bad)


def test_label_distribution_skips_nulls(spark):
    frame = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "label string")
    assert [tuple(r) for r in corpus.label_distribution(frame).collect()] == [("b", 2), ("a", 1)]
    names = spark.createDataFrame([(0,), (1,), (2,), (9,), (None,)], "c int").select(label_name("c"))
    assert [r[0] for r in names.collect()] == ["normal", "hate", "offensive", "unknown", "unknown"]


def test_row_form_equals_long_form(spark, labelled):
    clean = labelled.withColumnRenamed("text", "processed")
    vocab = features.fit_vocabulary(clean, min_df=3)
    words = sorted(vocab.select("idx", "term", "idf").collect())
    long_form = features.tfidf(features.term_freq(clean), vocab)
    rows = features.weigh_terms(
        features.count_terms(clean, [w.term for w in words]), [w.idf for w in words]
    )
    got = {(r.id, words[i].term): w for r in rows.collect()
           for i, w in zip(r.indices, r.weights, strict=True)}
    want = {(r.id, r.term): r.weight for r in long_form.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    vectors = linear.feature_vectors(clean, [w.term for w in words], [w.idf for w in words])
    for r in vectors.select("id", "features").limit(20).collect():
        dense = r.features.toArray()
        assert dense[-1] == 1.0
        assert np.allclose(dense[:-1], [got.get((r.id, w.term), 0.0) for w in words])


def test_vocabulary_rules(spark):
    rows = [(i, "ሀሁ " + ("ለሉ " * (i % 2 + 1) if i < 6 else "") + ("መሙ" if i < 3 else "")) for i in range(10)]
    frame = spark.createDataFrame(rows, "id long, processed string")
    kept = features.doc_freq(frame, min_df=4, max_df=0.8)
    assert [tuple(r) for r in kept.select("term", "df", "cf").collect()] == [("ለሉ", 6, 9)]
    loose = features.vocabulary(features.doc_freq(frame, min_df=1, max_df=1.0), 2)
    assert [tuple(r) for r in loose.orderBy("idx").select("idx", "term").collect()] == [
        (0, "ሀሁ"), (1, "ለሉ")]


def test_fit_minimises_the_weighted_penalised_loss(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4)) * (rng.random((90, 4)) < 0.7)
    y = rng.choice([0, 1, 2], size=90, p=[0.6, 0.25, 0.15])
    x[np.arange(90), y] += 1.0
    x = np.hstack([x, np.ones((90, 1))])
    frame = spark.createDataFrame(
        [(Vectors.dense(row), int(c)) for row, c in zip(x, y, strict=True)], ["features", "label"]
    )
    classes, weights = linear.fit_ovr(frame)
    assert classes == (0, 1, 2)
    for c, w in zip(classes, np.array(weights), strict=True):
        sign = np.where(y == c, 1.0, -1.0)
        cost = np.where(y == c, len(y) / (3 * (y == c).sum()), 1.0)
        margin = sign * (x @ w)
        gradient = w - x.T @ (cost * sign / (1 + np.exp(margin)))
        assert np.abs(gradient).max() < 1e-3


def test_two_classes(spark, labelled):
    two = labelled.where("label <> '2'").select(
        F.col("text").alias("processed"), F.col("label").cast("int").alias("label")
    )
    rows = linear.feature_vectors(two, WORDS, [1.0] * len(WORDS))
    classes, weights = linear.fit_ovr(rows)
    assert classes == (0, 1) and np.allclose(weights[0], -np.array(weights[1]))
    with pytest.raises(ValueError, match="two classes"):
        linear.fit_ovr(rows.where("label = 0"))




def test_predict(spark):
    rows = spark.createDataFrame(
        [(1, "ሰላም"), (2, "ጥላቻ ጥላቻ"), (3, "ስድብ"), (4, "ቡና"), (5, "ጥላቻ ስድብ")],
        "id long, processed string",
    )
    model = small_model()
    got = {r.id: r for r in linear.predict(rows, model).collect()}
    assert [got[i].label for i in (1, 2, 3, 4)] == ["normal", "hate", "offensive", "normal"]
    assert got[4].nnz == 0 and got[4].scores == [0.25, 0.25, 0.1]  # a tie goes to the first class
    w = np.array([1.5, 2.0]) / 2.5
    assert np.allclose(got[5].scores, [0.25 - w.sum(), 0.25 + w @ [0.5, 1.0], 0.1 + w @ [1.0, 0.5]])
    vocab = model.vocabulary_table(spark)
    joined = linear.predict_long(
        rows, vocab, model.named_coefficients(spark), dict(zip(model.classes, model.intercept))
    )
    for r in joined.collect():
        assert (r.nnz, r.label) == (got[r.id].nnz, got[r.id].label)
        assert np.allclose(r.scores, got[r.id].scores)


def test_descent_in_blocks_through_the_tree(spark, monkeypatch):
    """Many partitions, sparse and dense rows, empty blocks: the same minimum."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 6)) * (rng.random((80, 6)) < 0.5)
    x[:, 5] = 1.0
    y = rng.choice([3, 7], size=80)
    vectors = [Vectors.dense(r) if i % 3 else Vectors.sparse(6, {j: v for j, v in enumerate(r) if v}) for i, r in enumerate(x)]
    frame = spark.createDataFrame([(v, int(c)) for v, c in zip(vectors, y, strict=True)], ["features", "label"])
    plain_classes, plain = linear.fit_ovr(frame, partitions=1)
    monkeypatch.setattr(logistic, "FAN_IN", 3)
    classes, weights = linear.fit_ovr(frame, partitions=20)
    assert classes == plain_classes == (3, 7) and np.allclose(weights, plain, atol=1e-4)
    w = np.array(weights[1])
    sign = np.where(y == 7, 1.0, -1.0)
    cost = np.where(y == 7, 80 / (2 * (y == 7).sum()), 80 / (2 * (y == 3).sum()))
    gradient = w - x.T @ (cost * sign / (1 + np.exp(sign * (x @ w))))
    assert np.abs(gradient).max() < 1e-3


def test_training_job(spark, labelled):
    result = train(labelled, TrainingConfig(min_df=2, max_df=1.0))
    assert set(WORDS[3:5]) <= set(result.model.terms) and result.model.classes == (0, 1, 2)
    assert result.predictions.count() == 60
    assert result.accuracy().first()[0] > 0.6
    assert {r.name for r in result.report().collect()} == {
        "normal", "hate", "offensive", "accuracy", "macro avg", "weighted avg"}
    cells = result.confusion().collect()
    assert sum(sum(r[1:]) for r in cells) == 60
    with pytest.raises(ValueError, match="no usable text"):
        train(labelled.withColumn("text", F.lit("latin only")))


def test_report_counts_absent_classes(spark):
    frame = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, prediction int")
    rows = {r.name: r for r in metrics.classification_report(frame).collect()}
    assert tuple(rows["offensive"])[1:] == (0.0, 0.0, 0.0, 0)
    assert rows["normal"].precision == 1.0 and rows["normal"].recall == 0.5
    assert rows["hate"].support == 1 and abs(rows["accuracy"].f1 - 2 / 3) < 1e-12
    assert [tuple(r) for r in metrics.confusion_matrix(frame).collect()] == [
        (0, 1, 1, 0), (1, 0, 1, 0), (2, 0, 0, 0)]


def test_training_refuses_classes_without_a_name(spark):
    frame = spark.createDataFrame([(0,), (7,), (1,)], "label int")
    with pytest.raises(ValueError, match="from 7 to 7"):
        corpus.check_labels(frame)


def test_split_preconditions(spark):
    lonely = spark.createDataFrame([(i, int(i == 0)) for i in range(20)], "id bigint, label int")
    with pytest.raises(ValueError, match="single row"):
        corpus.stratified_split(lonely)
    few = spark.createDataFrame([(i, i % 3) for i in range(6)], "id bigint, label int")
    with pytest.raises(ValueError, match="fewer rows"):
        corpus.stratified_split(few)


def test_metrics_refuse_other_classes(spark):
    pairs = spark.createDataFrame([(7, 0), (0, 0)], "label int, prediction int")
    for table in (metrics.classification_report(pairs), metrics.confusion_matrix(pairs)):
        with pytest.raises(Exception, match="found label 7"):
            table.collect()


def test_few_sums_reach_the_driver_whatever_the_tasks(spark, monkeypatch):
    rows = spark.range(0, 48, 1, 12).selectExpr("cast(id % 2 as int) AS label", "cast(id AS double) AS x")
    vectors = spark.createDataFrame(
        [(r.label, Vectors.dense([r.x, 1.0])) for r in rows.collect()], ["label", "features"]
    ).repartition(12)
    blocks = logistic.sparse_blocks(vectors, "features", "label")
    sent, collect = [], type(blocks).collect
    monkeypatch.setattr(type(blocks), "collect", lambda df: sent.append(collect(df)) or sent[-1])
    loss, slope = logistic.evaluate(blocks, 12, np.zeros((1, 2)), np.array([[-1.0, 1.0]]), [0, 1])
    assert len(sent) == 1 and len(sent[0]) <= logistic.AT_DRIVER
    assert loss[0] == pytest.approx(48 * math.log(2))
    assert slope[0] == pytest.approx([-12.0, 0.0])


def test_the_registered_fit_reads_a_cleaned_corpus(spark, monkeypatch):
    from workload import queries

    class Model:
        def coefficient_table(self, spark):
            return None

    given = []
    monkeypatch.setattr(queries.inputs, "corpus", lambda spark, sf: spark.createDataFrame(
        [(1, "ab cd", "0"), (2, "", "1"), (3, "xy", "1")], "id long, text string, label string"
    ).withColumn("text", queries.inputs.fidel("text")))
    monkeypatch.setattr(queries, "fit_model", lambda rows: given.append(rows) or Model())
    queries.m8_fit_ovr(spark, "")
    assert "translate(" not in given[0]._jdf.queryExecution().toString()
    assert sorted(r.id for r in given[0].collect()) == [1, 3]


def test_long_prediction_reads_its_texts_once(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "zz"), (3, ""), (None, "aa"), (4, "bb"), (4, "aa")], "id long, processed string")
    vocab = spark.createDataFrame([("AA", 1.0), ("BB", 2.0)], "term string, idf double")
    weights = spark.createDataFrame([(0, "AA", 1.0), (1, "BB", 1.0)], "class int, term string, coef double")
    upper = df.withColumn("processed", F.upper("processed")).withColumn("processed", F.lower("processed"))
    scored = linear.predict_long(upper, vocab.withColumn("term", F.lower("term")), weights.withColumn("term", F.lower("term")), {0: 0.0, 1: 0.5})
    assert "upper(" not in scored._jdf.queryExecution().toString()
    assert sorted((r.id or 0, r.nnz) for r in scored.collect()) == [(0, 0), (1, 2), (2, 0), (3, 0), (4, 2), (4, 2)]


def test_term_stats_make_no_struct_per_token(spark):
    df = spark.createDataFrame([("aa bb aa",), ("aa",), ("",), (None,)], "processed string")
    stats = features.term_stats(df)
    assert sorted(stats.collect()) == [("aa", 2, 3), ("bb", 1, 1)]
    assert "struct(" not in stats._jdf.queryExecution().optimizedPlan().toString()


def test_a_descent_remembers_enough_steps_for_many_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2_000, 120)) * np.logspace(1, -0.5, 120)
    sign = np.sign(x @ rng.normal(size=120) + 20 * rng.normal(size=2_000))
    fit = logistic.Descent(np.zeros(120), 1e-6)
    for passes in range(500):
        if fit.done:
            break
        w = fit.trial
        pull = sign / (1 + np.exp(sign * (x @ w)))
        fit.take(np.logaddexp(0, -sign * (x @ w)).sum() + w @ w / 2, w - x.T @ pull)
    assert fit.done and passes < 150


def test_blocks_are_small_and_hold_every_row(spark):
    """Rows without entries, places beyond two bytes and more rows than a block has."""
    rng = np.random.default_rng(2)
    n, wide = 300, 70_000
    places = [sorted(rng.choice(wide if i > 200 else 50, 3 * (i % 7 > 0), replace=False).tolist()) for i in range(n)]
    frame = spark.createDataFrame(
        [(i % 2, Vectors.sparse(wide, p, rng.normal(size=len(p)).tolist())) for i, p in enumerate(places)], ["label", "features"]
    ).coalesce(1)
    blocks = logistic.sparse_blocks(frame, "features", "label")
    rows = blocks.collect()
    assert [len(r.classes) // 4 for r in rows] == [128, 128, 44]
    assert [len(r.places) * 8 // len(r.values) for r in rows] == [2, 4, 4]
    w = rng.normal(size=(1, wide))
    loss, slope = logistic.evaluate(blocks, 1, w, np.array([[-1.0, 2.0]]), [0, 1])
    expected, gradient = 0.0, np.zeros(wide)
    for r in frame.collect():
        sign, cost = (1, 2.0) if r.label else (-1, 1.0)
        score = w[0, r.features.indices] @ r.features.values
        expected += cost * np.logaddexp(0, -sign * score)
        gradient[r.features.indices] -= cost * sign * r.features.values / (1 + np.exp(sign * score))
    assert loss[0] == pytest.approx(expected) and np.allclose(slope[0], gradient)


def test_classes_at_their_minimum_are_not_passed_over_again(monkeypatch):
    given = []

    class Blocks:
        class rdd:
            getNumPartitions = staticmethod(lambda: 1)

    def evaluate(blocks, parts, weights, costs, labels):
        given.append(costs[:, 0].tolist())
        # The first class has its minimum where it starts, the second one beside it.
        return np.array([(w[0] - c) ** 2 for w, c in zip(weights, costs[:, 0])]), np.array([2 * (w - c) for w, c in zip(weights, costs[:, 0])])

    monkeypatch.setattr(logistic, "evaluate", evaluate)
    found = logistic.minimise(Blocks, 1, np.array([[0.0], [3.0]]), [0], 0.0, 1e-6, 50)
    assert np.allclose(found, [[0.0], [3.0]])
    assert given[0] == [0.0, 3.0] and given[1:] == [[3.0]] * (len(given) - 1) and len(given) > 2


def test_the_check_of_the_minimum_makes_a_line_per_row_and_term(spark):
    """Not one for each class too; the classes' gradients are those of a plain loop."""
    from fidelscope.operators.model import TextModel
    from workload import queries

    rows = spark.createDataFrame(
        [(1, "aa bb"), (0, "aa"), (2, "bb bb"), (0, ""), (None, "aa"), (1, "zz"), (1, "zz")], "label int, processed string")
    flat = TextModel((0, 1, 2), ("aa", "bb"), (1.0, 1.0), ((0.0, 0.0),) * 3, (0.0,) * 3)
    assert {(r["class"], r.n_terms, r.is_minimum) for r in queries.flatness(spark, rows, flat).collect()} == {
        (k, 2, False) for k in range(3)}
    classes, weights = linear.fit_ovr(linear.feature_vectors(rows.where("label IS NOT NULL"), flat.terms, flat.idf))
    fitted = TextModel(classes, flat.terms, flat.idf, tuple(tuple(w[:-1]) for w in weights), tuple(w[-1] for w in weights))
    found = queries.flatness(spark, rows.where("label IS NOT NULL"), fitted)
    assert {(r["class"], r.is_minimum) for r in found.collect()} == {(k, True) for k in range(3)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[idx#\d+L?\]", plan) and not re.search(r"Aggregate \[class#\d+, idx", plan)
