"""Preparation stored with models, searches across learners, calibration across folds."""

import glob
import math

import duckdb
import pytest
from pyspark.sql import functions as F
from support import rows

from lapsewise.functions import percent_bucket
from lapsewise.operators import evaluation, explain, models, prepare
from lapsewise.session import work_path


@pytest.fixture(scope="module")
def table(spark):
    """x has outliers and gaps, y is empty in training, the label follows the group."""
    return spark.range(600).select(
        F.col("id").alias("customer_id"), F.when(F.col("id") < 590, (F.col("id") % 3).cast("string")).otherwise("new").alias("group"),
        F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 50 == 1, 1e6).otherwise(F.col("id") % 100).cast("double")).alias("x"),
        F.when(F.col("id") >= 400, F.lit(5.0)).alias("y"),
        ((F.col("id") * 37 % 100) < F.when(F.col("id") % 3 == 0, 20).when(F.col("id") % 3 == 1, 50).otherwise(85)).cast("int").alias("churned"),
    )


def test_preparation_survives_saving_and_another_session(spark, table):
    train = table.where("customer_id < 400")
    model = models.Pipeline(stages=prepare.input_stages(["x", "y"], ["group"], (0.05, 0.95))).fit(train)
    path = work_path(spark, "prepared")
    models.save_model(model, path)
    other = spark.newSession()
    loaded = models.load_model(path)
    there = other.createDataFrame([(1, None, -5.0, 2.0, 0), (2, "0", None, None, 1), (3, "2", 1e9, 1.0, 1)], "customer_id bigint, group string, x double, y double, churned int")
    cols = ["customer_id", "_p_x", "_p_x_missing", "_p_y", "_p_y_missing", "_i_group"]
    got = [tuple(r) for r in loaded.transform(there).orderBy("customer_id").select(*cols).collect()]
    xs = sorted(r.x for r in train.where("x is not null").collect())

    def at(p):
        place = p * (len(xs) - 1)
        lo = math.floor(place)
        return xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (place - lo)

    lo, hi = at(0.05), at(0.95)
    mean = sum(min(max(x, lo), hi) for x in xs) / len(xs)
    assert hi < 1e6
    # y was never seen in training: no limits, filled with 0; an unknown group has the last place.
    want = [(1, lo, 0, 2.0, 0, 3), (2, mean, 1, 0.0, 1, 0), (3, hi, 0, 1.0, 0, 2)]
    assert len(got) == 3 and all(tuple(map(float, g)) == pytest.approx(w) for g, w in zip(got, want))
    want = rows(model.transform(table), *cols[:2])
    assert rows(loaded.transform(table), *cols[:2]) == want


def test_fitted_models_keep_their_preparation(spark, table):
    train = table.where("customer_id < 400")
    for fit in (models.fit_logistic, models.fit_gbt):
        model = fit(train, ["x", "y"], categories=["group"], clip=(0.05, 0.95))
        path = work_path(spark, "model")
        models.save_model(model, path)
        scored = models.score(models.load_model(path), table, ["x", "y"])
        assert scored.columns == [*table.columns, "probability", "margin", "predicted"]
        assert rows(scored) == rows(models.score(model, table, ["x", "y"]))
    known = explain.background(train, ["x", "y", "group"], 8)
    told = explain.explain_sampled(model, table.where("customer_id < 20"), ["x", "y", "group"], known)
    biggest = told.groupBy("feature").agg(F.sum(F.abs("contribution")).alias("c")).orderBy(F.desc("c")).first()
    assert biggest["feature"] == "group" and told.count() == 60


def test_search_halves_and_its_measures_are_those_of_the_stored_scores(spark, table):
    data = table.where("customer_id < 590")
    learners = {
        "group": lambda t: models.fit_logistic(t, (), categories=["group"]),
        "trees": lambda t: models.fit_gbt(t, ["x"], categories=["group"], rounds=3, depth=2),
        "x": lambda t: models.fit_logistic(t, ["x"], clip=(0.05, 0.95)),
        "y": lambda t: models.fit_logistic(t, ["y"], clip=(0.05, 0.95)),
    }
    path = work_path(spark, "search")
    model, report = models.search(data, learners, path, ["x", "y"], rungs=(50, 100))
    found = [tuple(r) for r in report.orderBy("rung", "candidate", "fold").collect()]
    first = {r[1]: r[5] for r in found if r[0] == 0}
    assert first == {"group": 1, "trees": 1, "x": 0, "y": 0}
    assert {r[1] for r in found if r[0] == 1} == {"group", "trees"} and sum(r[5] for r in found if r[0] == 1) == 3
    stored = duckdb.connect()
    stored.sql(f"CREATE VIEW s AS SELECT * FROM read_parquet({[f for f in glob.glob(path.removeprefix('file://') + '/*.parquet')]})")
    want = stored.sql("""SELECT p.rung, p.candidate, p.fold,
        sum(CASE WHEN p.probability > n.probability THEN 1.0 WHEN p.probability = n.probability THEN 0.5 ELSE 0 END) / count(*) AS auc
      FROM s p JOIN s n ON p.rung = n.rung AND p.candidate = n.candidate AND p.fold = n.fold
      WHERE p.churned = 1 AND n.churned = 0 GROUP BY ALL ORDER BY 1, 2, 3""").fetchall()
    assert [(r[0], r[1], r[2], pytest.approx(r[4])) for r in found] == want
    # Rungs are nested, and a customer stays in its fold.
    assert stored.sql("SELECT count(*) FROM (SELECT customer_id, fold FROM s WHERE rung = 0 EXCEPT SELECT customer_id, fold FROM s WHERE rung = 1)").fetchall() == [(0,)]
    assert stored.sql("SELECT max(n) FROM (SELECT count(DISTINCT fold) AS n FROM s GROUP BY customer_id)").fetchall() == [(1,)]
    assert models.score(model, data, ["x", "y"]).count() == 590


def pooled(points):
    """Isotonic rates of (score, ones, n) by pooling neighbours."""
    blocks = []
    for x, ones, n in points:
        blocks.append([x, x, ones, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, ones, n = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + ones, blocks[-1][3] + n]
    return blocks


def test_calibration_is_exact_beyond_ten_thousand_scores(spark):
    rows_ = spark.range(24_000).select(
        F.col("id").alias("customer_id"), ((F.col("id") * 7919 % 24_000) / 24_000.0).alias("probability"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) < (F.col("id") * 7919 % 24_000) / 30).cast("int").alias("churned"),
    )
    done = evaluation.calibrate(rows_, evaluation.fit_calibration(rows_)).orderBy("probability").collect()
    assert len({r.probability for r in done}) == 24_000
    want = [ones / n for _, _, ones, n in pooled([(r.probability, r.churned, 1) for r in done]) for _ in range(n)]
    assert [r.calibrated for r in done] == pytest.approx(want)
    assert len(set(want)) < 24_000 ** (2 / 3)


def test_no_row_is_judged_by_its_own_fold(spark):
    rows_ = spark.range(500).select(
        F.col("id").alias("customer_id"), (F.col("id") % 20 / 20.0).alias("probability"),
        F.when(F.col("id") % 11 > 0, (F.col("id") % 20 > F.col("id") % 13).cast("int")).alias("churned"),
    )
    done = evaluation.calibrate_crosswise(rows_, folds=3)
    assert done.columns == [*rows_.columns, "calibrated"] and done.count() == 500
    folds = {r.customer_id: r.f for r in rows_.select("customer_id", (percent_bucket("customer_id", "calibration") % 3).alias("f")).collect()}
    data = rows_.collect()
    got = {r.customer_id: r.calibrated for r in done.collect()}
    for k in range(3):
        sums = {}
        for r in data:
            if folds[r.customer_id] != k and r.churned is not None:
                ones, n = sums.get(r.probability, (0, 0))
                sums[r.probability] = ones + r.churned, n + 1
        curve = {}
        for lo, hi, ones, n in pooled([(x, *sums[x]) for x in sorted(sums)]):
            curve |= {x: ones / n for x in sums if lo <= x <= hi}
        for r in data:
            if folds[r.customer_id] == k:
                assert got[r.customer_id] == pytest.approx(curve[r.probability])
    alone = evaluation.calibrate_crosswise(rows_.where("customer_id = 3"), folds=3)
    assert rows(alone, "calibrated") == [(None,)]
    assert not rows(evaluation.calibrate_crosswise(rows_.limit(0), folds=3))
