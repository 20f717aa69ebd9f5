import datetime as dt

import pytest
from pyspark.sql import functions as F
from support import SMALL, purchases, rows

from lapsewise import sources
from lapsewise.operators import features, labels
from lapsewise.operators.panel import line_panel, panel
from lapsewise.operators.quality import fk_check, handle_missing
from lapsewise.plans import churn

DAY, HORIZON = "2001-02-01", 180
BOUNDARY = [
    (1, 10, "2000-01-01", 10.00),
    (1, 11, "2001-01-31", 20.00),
    (1, 12, "2001-02-01", 5.00),
    (2, 20, "2000-08-05", 7.50),
    (2, 21, "2001-07-31", 1.00),
    (3, 30, "2001-03-01", 9.00),
    (5, 50, "2000-12-01", 4.00),
]


@pytest.fixture(scope="module")
def boundary(spark):
    people = spark.createDataFrame([(1,), (2,), (3,), (4,)], "customer_id bigint")
    return purchases(spark, BOUNDARY), people


def test_boundary_population(boundary):
    orders, people = boundary
    assert rows(fk_check(orders, "customer_id", people, "customer_id")) == [(5, 1)]
    assert rows(handle_missing(orders, people, "quarantine"), "order_id") == [(50,)]
    known = handle_missing(orders, people, "drop")
    assert rows(labels.churn_label(known, DAY, HORIZON)) == [(1, 0), (2, 1)]
    filled = handle_missing(orders, people, "placeholder")
    assert rows(filled.where("placeholder"), "customer_id") == [(5,)]


def test_boundary_features(boundary):
    orders, people = boundary
    known = handle_missing(orders, people, "drop")
    got = features.order_features(known, DAY).select(
        "customer_id", "recency", "frequency", F.col("monetary").cast("double"), "mean_gap", "max_gap"
    )
    assert rows(got) == [(1, 1, 2, 30.0, 396.0, 396), (2, 180, 1, 7.5, None, None)]
    one = features.snapshot(known, DAY, HORIZON).select("customer_id", "recency", "frequency", "churned")
    assert rows(one) == [(1, 1, 2, 0), (2, 180, 1, 1)]


def test_same_day_orders_are_zero_gaps(spark):
    orders = purchases(spark, [(1, 1, "2000-01-01", 1), (1, 2, "2000-01-01", 1), (1, 3, "2000-01-11", 1), (2, 4, "2000-01-01", 1), (2, 5, "2000-01-01", 1)])
    got = {r["customer_id"]: r for r in features.gaps(orders, DAY).collect()}
    assert (got[1]["mean_gap"], got[1]["max_gap"]) == (5.0, 10)
    assert got[1]["sd_gap"] == pytest.approx(50**0.5)
    assert (got[2]["mean_gap"], got[2]["max_gap"], got[2]["sd_gap"]) == (0.0, 0, None)


def test_later_orders_change_no_feature(spark):
    """Leak check: orders at or after the snapshot are moved, repriced and multiplied."""
    orders = sources.purchases(spark, SMALL)
    day = dt.datetime(2001, 2, 1)
    later = orders.where(F.col("order_ts") >= F.lit(day).cast("timestamp_ntz"))
    tampered = orders.where(F.col("order_ts") < F.lit(day).cast("timestamp_ntz")).unionByName(
        later.withColumn("cents", F.col("cents") * 7)
    ).unionByName(later.withColumn("order_id", F.col("order_id") + 10**9))
    i = churn.Inputs(spark, SMALL)
    a = churn.feature_table(i, DAY)
    b = churn.feature_table(i.with_purchases(tampered), DAY)
    assert rows(a.drop("sd_gap")) == rows(b.drop("sd_gap"))


@pytest.mark.parametrize("spacing", [10, 92, 400])
def test_panel_equals_single_snapshots(spark, spacing):
    orders = sources.purchases(spark, SMALL)
    snaps = [dt.date(2001, 2, 1) - dt.timedelta(days=spacing * i) for i in range(4)]
    wide = panel(orders, snaps, HORIZON, (180, 365))
    for s in snaps:
        got = wide.where(F.col("snapshot") == F.lit(s))
        one = (
            features.snapshot(orders, s, HORIZON, (180, 365))
            .join(features.gaps(orders, s).select("customer_id", "mean_gap", "max_gap"), "customer_id")
        )
        cols = ["customer_id", "recency", "frequency", "monetary", "mean_order", "tenure", "mean_gap",
                "max_gap", "orders_180", "spend_180", "orders_365", "spend_365", "churned"]
        assert rows(got, *cols) == rows(one, *cols)


def test_censor_guard(boundary):
    orders, _ = boundary
    got = labels.guard(orders, ["2001-02-01", "2001-02-02"], HORIZON)
    assert rows(got, "snapshot", "censored") == [("2001-02-01", 0), ("2001-02-02", 1)]


def test_imputation_and_scaling_use_training_rows_only(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None), (4, 100.0)], "customer_id bigint, x double")
    train = df.where("customer_id < 3")
    filled = features.impute(df, features.impute_values(train, {"x": "median"}))
    assert rows(filled, "customer_id", "x", "x_missing") == [(1, 1.0, 0), (2, 3.0, 0), (3, 2.0, 1), (4, 100.0, 0)]
    limits = features.winsor_limits(train, ["x"], 0.0, 1.0)
    assert rows(features.winsorize(df, ["x"], limits)) == [(1, 1.0), (2, 3.0), (3, None), (4, 3.0)]
    scaled = features.standardize(df, ["x"], features.moments(train, ["x"]))
    assert [round(r[1], 6) for r in rows(scaled.where("customer_id in (1, 2)"))] == [-0.707107, 0.707107]
    constant = features.standardize(df, ["x"], features.moments(df.where("customer_id = 1"), ["x"]))
    assert constant.where("x is not null").count() == 0


def test_a_thousand_snapshots(spark):
    first = dt.date(2000, 1, 1)
    days = [first + dt.timedelta(days=n) for n in range(1000)]
    p = purchases(spark, [(1, 1, "2000-01-05", 2.0), (1, 2, "2000-03-01", 3.0), (2, 3, "2002-01-01", 1.0)])
    got = panel(p, days, 30).select("snapshot", "customer_id", "recency", "churned")
    assert got.where("customer_id = 1").count() == 1000 - 5
    row = got.where("customer_id = 1 and snapshot = date'2000-03-02'").first()
    assert (row["recency"], row["churned"]) == (1, 1)


def test_mix_counts_unknown_types_and_missing_parts(spark):
    bought = purchases(spark, [(1, 10, "2000-06-01", 1.0), (2, 20, "2000-06-01", 1.0)])
    lines = spark.createDataFrame(
        [(10, 1, 1000), (10, 2, 2000), (10, 3, 500), (10, 9, 500), (20, 9, 100)], "order_id bigint, part_id bigint, quantity_hundredths bigint"
    ).withColumn("discount_bp", F.lit(0).cast("bigint"))
    parts = spark.createDataFrame([(1, "PROMO"), (2, "BRASS"), (3, "TIN")], "part_id bigint, part_type string")
    wanted = ("customer_id", "share_promo", "share_small", "share_other", F.round("mix_entropy", 6), "favourite_type")
    want = [(1, 0.25, 0.0, 0.75, 1.213008, "BRASS"), (2, 0.0, 0.0, 1.0, 0.0, None)]
    assert rows(features.mix(bought, lines, parts, DAY), *wanted) == want
    assert rows(features.line_features(bought, lines, parts, DAY), *wanted, "distinct_parts") == [(*want[0], 4), (*want[1], 1)]
    assert rows(line_panel(bought, lines, parts, [DAY]), *wanted) == want
