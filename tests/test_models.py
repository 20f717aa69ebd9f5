"""Learners on a planted signal, and explanations that add up."""

import pytest
from pyspark.sql import functions as F
from support import rows

from lapsewise.operators import evaluation, explain, features, labels, models, segments
from lapsewise.plans import churn
from lapsewise.session import freeze, work_path

COLS = ("x1", "x2", "x3")


def unit(name, salt):
    """0..1 from a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(name).cast("string"))), 1, 8), 16, 10).cast(
        "double"
    ) / 2.0**32


@pytest.fixture(scope="module")
def planted(spark):
    df = spark.range(3000).select(
        F.col("id").alias("customer_id"), unit("id", "a").alias("x1"), unit("id", "b").alias("x2"),
        F.when(F.col("id") % 10 > 0, unit("id", "c")).alias("x3"), unit("id", "noise").alias("noise"),
    )
    signal = 6 * (F.col("x1") - 0.5) + 2 * (F.col("x2") - 0.5) + 0.6 * (F.col("noise") - 0.5)
    table, _ = freeze(labels.split_by_key(df.withColumn("churned", (signal > 0).cast("int"))))
    return table, table.where("split = 'train'"), table.where("split = 'test'")


@pytest.fixture(scope="module")
def logistic(planted):
    return models.fit_logistic(planted[1], COLS)


def area(scored):
    return evaluation.auc(scored).first()["auc"]


def test_learners_find_the_signal(planted, logistic):
    _, train, test = planted
    assert area(models.score(logistic, test, COLS)) > 0.9
    boosted = models.fit_gbt(train, COLS, rounds=8, depth=3)
    scored = models.score(boosted, test, COLS)
    assert area(scored) > 0.9
    assert scored.where("probability < 0 or probability > 1").count() == 0
    again = models.score(models.fit_gbt(train, COLS, rounds=8, depth=3), test, COLS)
    assert rows(scored, "customer_id", "probability") == rows(again, "customer_id", "probability")


def test_no_signal_no_score(spark):
    table = labels.split_by_key(churn.training_table(churn.Inputs(spark, "/root/testdata/sf0.01")))
    table, _ = freeze(table)
    cols = churn.MODEL_COLUMNS
    model = models.fit_logistic(table.where("split = 'train'"), cols)
    assert 0.4 < area(models.score(model, table.where("split = 'test'"), cols)) < 0.6


def test_class_weights_balance(planted):
    weighted = labels.class_weight(planted[0])
    sums = [r[0] for r in weighted.groupBy("churned").agg(F.sum("weight")).select("sum(weight)").collect()]
    assert sums[0] == pytest.approx(sums[1]) == pytest.approx(1500)


def test_auc_equals_evaluator(planted, logistic):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    scored = models.score(logistic, planted[2], COLS).withColumn("p", F.round("probability", 1))
    want = BinaryClassificationEvaluator(labelCol="churned", rawPredictionCol="p", numBins=0).evaluate(scored)
    for limit in (0, 10_000):
        got = evaluation.auc(scored, "p", single_task_rows=limit).first()["auc"]
        assert got == pytest.approx(want, abs=1e-9)


def test_save_and_load(planted, logistic, spark):
    path = work_path(spark, "model")
    models.save_model(logistic, path)
    cols = ("customer_id", "probability")
    assert rows(models.score(models.load_model(path), planted[2], COLS), *cols) == rows(
        models.score(logistic, planted[2], COLS), *cols
    )


def test_tuning_marks_one_best(planted):
    model, report = models.tune(planted[1], COLS, (0.001, 10.0))
    assert report.where("best = 1").first()["reg"] == 0.001
    assert area(models.score(model, planted[2], COLS)) > 0.9


def test_importance_ranks_the_signal(planted, logistic):
    for limit in (0, 10_000):
        drop = {r["feature"]: r["auc_drop"] for r in models.importance(logistic, planted[2], COLS, single_task_rows=limit).collect()}
        assert drop["x1"] > drop["x2"] > abs(drop["x3"])


def test_linear_contributions_add_up_to_the_margin(planted, logistic):
    parts = explain.explain_linear(logistic, planted[2], COLS)
    total = parts.groupBy("customer_id").agg(F.sum("contribution").alias("total"))
    both = models.score(logistic, planted[2], COLS).join(total, "customer_id")
    base = logistic.stages[-1].intercept
    worst = both.agg(F.max(F.abs(F.col("margin") - F.col("total") - base))).first()[0]
    assert worst < 1e-9
    top = explain.reasons(parts, 1).groupBy("feature").count().orderBy(F.desc("count")).first()
    assert top["feature"] == "x1"


def test_sampled_contributions_telescope(planted, logistic):
    _, train, test = planted
    some = test.where("customer_id < 100")
    ground = explain.background(train, COLS, 4)
    parts = explain.explain_sampled(logistic, some, COLS, ground)
    total = parts.groupBy("customer_id").agg(F.sum("contribution").alias("total"))
    base = models.score(logistic, ground, COLS).agg(F.avg("probability")).first()[0]
    both = models.score(logistic, some, COLS).join(total, "customer_id")
    assert both.count() == some.count()
    assert both.agg(F.max(F.abs(F.col("probability") - base - F.col("total")))).first()[0] < 1e-9


def test_calibration_is_monotone_and_unbiased(planted, logistic):
    scored = models.score(logistic, planted[2], COLS)
    done = evaluation.calibrate(scored, evaluation.fit_calibration(scored)).orderBy("probability").collect()
    values = [r["calibrated"] for r in done]
    assert all(a <= b + 1e-9 for a, b in zip(values, values[1:]))
    assert sum(values) == pytest.approx(sum(r["churned"] for r in done), rel=0.02)


def test_calibration_keeps_crowded_scores_apart(spark):
    """All scores within a hundred-thousandth, and the rate rises along them."""
    made = [(0.5 + i * 1e-9, int(i % 10 < i // 1000)) for i in range(10_000)]
    scored = spark.createDataFrame(made, "probability double, churned int")
    done = evaluation.calibrate(scored, evaluation.fit_calibration(scored, cells=50))
    low, high = done.agg(F.min("calibrated"), F.max("calibrated")).first()
    assert low < 0.1 and high > 0.8


def test_encode_puts_unseen_values_last(spark):
    train = spark.createDataFrame([(1, "b"), (2, "a")], "customer_id bigint, s string")
    df = spark.createDataFrame([(1, "b"), (3, "zz")], "customer_id bigint, s string")
    assert rows(features.encode(df, ["s"], train), "customer_id", "s_index") == [(1, 1.0), (3, 2.0)]


def test_clusters_cover_everyone(spark):
    data = [(i, float(i % 3 * 100 + i % 7), float(i % 3)) for i in range(90)]
    df = spark.createDataFrame(data, "customer_id bigint, a double, b double")
    _, done = segments.kmeans(df, ("a", "b"), 3)
    assert done.groupBy("cluster").count().where("count = 30").count() == 3
    best = segments.choose_k(df, ("a", "b"), (2, 3, 4)).where("best = 1").first()
    assert best["k"] == 3


def test_assemble_refuses_missing_values(planted):
    with pytest.raises(Exception):
        models.assemble(planted[0], COLS).select(F.sum(models.vector_to_array("features")[2])).collect()
