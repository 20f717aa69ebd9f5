"""What the physical plans must and must not contain, and the batch run from end to end."""

import pytest
from pyspark.sql import functions as F
from support import SMALL, plan_text, purchases, rows

from lapsewise import sources
from lapsewise.operators import features, quality
from lapsewise.operators.facts import facts
from lapsewise.operators.panel import panel
from lapsewise.plans import churn
from lapsewise.plans.catalogue import QUERIES
from lapsewise.session import work_path


@pytest.fixture
def shuffle_joins(spark):
    """As at scale, where no side is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cut_and_columns_reach_the_scan(spark):
    plan = plan_text(features.rfm(sources.purchases(spark, SMALL), churn.DAY))
    assert "LessThan(o_orderdate,2001-02-01T00:00)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


@pytest.mark.parametrize(
    "name", ["d8_facts", "f10_running_spend", "f15_panel", "f16_feature_table", "a2_cohorts", "p2_lookup", "c1_eligible"]
)
def test_no_nested_loops_and_no_python(spark, name):
    plan = plan_text(QUERIES[name](spark, SMALL))
    for word in ("NestedLoop", "Cartesian", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan


def test_order_blocks_share_two_shuffles(shuffle_joins):
    plan = plan_text(features.order_features(sources.purchases(shuffle_joins, SMALL), churn.DAY))
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("FileScan") == 1


def test_panel_reads_orders_once_whatever_the_snapshots(shuffle_joins):
    plan = plan_text(panel(sources.purchases(shuffle_joins, SMALL), churn.SNAPSHOTS, churn.HORIZON))
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("FileScan") == 1


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan_text(df)


def test_hot_customer_join_is_split(shuffle_joins):
    """A customer with a third of the orders: adaptive execution splits the join side."""
    spark = shuffle_joins
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        orders = spark.range(60000).repartition(6).select(
            F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).alias("customer_id"),
            F.col("id").alias("order_id"), F.lit("2000-01-01").cast("timestamp_ntz").alias("order_ts"),
            F.lit(100).cast("bigint").alias("cents"),
        )
        people = spark.range(4000).select(F.col("id").alias("customer_id"))
        kept = quality.handle_missing(orders, people, "drop")
        assert "skew=true" in final_plan(kept)
        want = sum(1 for i in range(60000) if i % 3 == 0 or i % 5000 < 4000)
        assert kept.count() == want
        # An aggregation on the join key does not undo the split.
        totals = kept.groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("order_id"))
        assert "skew=true" in final_plan(totals)
        assert totals.agg(F.sum("n")).first()[0] == want
    finally:
        for key in small:
            spark.conf.unset(key)


def test_hot_customer_features_are_right(spark):
    """Day grain: a customer with thousands of orders meets as one row per day."""
    many = [(1, i, f"2000-{1 + i % 12:02d}-{1 + i % 28:02d}", 1.25) for i in range(3000)]
    orders = purchases(spark, many + [(2, 9001, "2000-05-05", 3.0)])
    got = {r["customer_id"]: r for r in features.order_features(orders, churn.DAY).collect()}
    assert got[1]["frequency"] == 3000 and float(got[1]["monetary"]) == 3750.0
    days = sorted({d[2] for d in many})
    assert got[1]["mean_gap"] == pytest.approx((got[1]["tenure"] - got[1]["recency"]) / 2999)
    assert features.by_day(orders).where("customer_id = 1").count() == len(days)
    window = features.running_spend(orders, 3).where("order_id = 9001").first()
    assert float(window["spend_window"]) == 3.0


def test_orders_without_lines_stay(spark):
    orders = purchases(spark, [(1, 10, "2000-01-01", 1.0), (1, 11, "2000-01-02", 2.0), (9, 12, "2000-01-02", 2.0)])
    lines = spark.createDataFrame([(10, 150), (10, 50)], "order_id bigint, quantity_hundredths bigint")
    people = spark.createDataFrame([(1, 3, "M")], "customer_id bigint, nation_id int, market_segment string")
    places = spark.createDataFrame([(3, "N", "R")], "nation_id int, nation string, region string")
    got = facts(orders, lines, people, places)
    assert rows(got, "order_id", "lines", F.col("quantity").cast("double"), "region") == [
        (10, 2, 2.0, "R"), (11, None, None, "R"),
    ]


@pytest.mark.parametrize("limit", [0, None])
def test_scored_customers_do_not_depend_on_the_ranking_path(spark, limit):
    i = churn.Inputs(spark, SMALL)
    got = churn.scored_customers(i, single_task_rows=limit)
    want = churn.scored_customers(i, single_task_rows=10**9)
    assert rows(got) == rows(want)
    listed = churn.campaign_list(i, scored=want, single_task_rows=limit)
    assert rows(listed) == rows(churn.campaign_list(i, scored=want, single_task_rows=10**9))
    assert listed.count() == listed.select("customer_id").distinct().count() > 0


def test_batch_run(spark):
    out = work_path(spark, "batch")
    paths = churn.run_batch(spark, SMALL, out)
    predicted = spark.read.parquet(paths["predictions"])
    assert predicted.count() == 150
    assert predicted.where("risk < 0 or risk > 100 or band is null or segment is null").count() == 0
    listed = spark.read.parquet(paths["campaigns"])
    spent = {r["campaign_id"]: r["total"] for r in listed.groupBy("campaign_id").agg(F.sum("cost").alias("total")).collect()}
    caps = {c.campaign_id: c.cap for c in churn.CAMPAIGNS}
    assert spent and all(spent[c] <= caps[c] for c in spent)
    assert {r["model_id"] for r in predicted.select("model_id").distinct().collect()} == {"gbt"}
    assert spark.read.parquet(paths["rejected"]).count() == spark.read.parquet(paths["key_faults"]).count() == 0
    assert spark.read.parquet(paths["violations"]).columns == ["table", "rule", "key"]
    assert spark.read.parquet(paths["evaluation"]).where("auc between 0 and 1").count() == 3
    told = listed.where("reason is not null").count()
    assert told == listed.count()
    # A second run of the day with one campaign leaves no other list behind.
    churn.run_batch(spark, SMALL, out, campaigns=churn.CAMPAIGNS[-1:])
    again = spark.read.parquet(f"{paths['campaigns']}/day={churn.DAY}")
    assert {r["campaign_id"] for r in again.select("campaign_id").distinct().collect()} <= {"thank_you"}
    with pytest.raises(ValueError, match="not known yet"):
        churn.run_batch(spark, SMALL, out, day="2030-01-01")
