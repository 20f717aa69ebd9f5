import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from support import plan_text, rows

from lapsewise.operators import campaigns as C
from lapsewise.operators import risk, segments, serving, store
from lapsewise.session import work_path

OFFERS = [
    C.Campaign("a", "v >= 20", 2, Decimal("3.00"), Decimal("9.00")),
    C.Campaign("b", "v < 40", 1, Decimal("2.50"), Decimal("6.00")),
]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(i, i * 10, "r") for i in range(1, 7)], "customer_id bigint, v int, region string")


@pytest.mark.parametrize("limit", [0, 1000])
def test_budget_is_reached_and_never_exceeded(scored, limit):
    candidates = C.eligible(scored, OFFERS)
    caps = {c.campaign_id: c.cap for c in OFFERS}
    got = C.budget(candidates, caps, "v", single_task_rows=limit)
    # a: exactly 9.00 by the third; b: the third would make 7.50 of 6.00.
    assert rows(got, "campaign_id", "customer_id", "place", F.col("spent").cast("double")) == [
        ("a", 4, 3, 9.0), ("a", 5, 2, 6.0), ("a", 6, 1, 3.0), ("b", 2, 2, 5.0), ("b", 3, 1, 2.5),
    ]


def test_assign_suppress_and_split(scored, spark):
    assigned = C.assign(scored, OFFERS)
    assert "Exchange" not in plan_text(assigned) and "Aggregate" not in plan_text(assigned)
    assert assigned.columns == C.eligible(scored, OFFERS).columns
    assert rows(assigned, "customer_id", "campaign_id") == [(1, "b"), (2, "b"), (3, "b"), (4, "a"), (5, "a"), (6, "a")]
    out = spark.createDataFrame([(4, "opted_out"), (4, "contacted"), (9, "opted_out")], "customer_id bigint, reason string")
    assert rows(C.suppress(assigned, out), "customer_id") == [(1,), (2,), (3,), (5,), (6,)]
    many = spark.range(2000).select(F.col("id").alias("customer_id"))
    arms = C.holdout(many, 10)
    control = rows(arms.where("arm = 'control'"), "customer_id")
    assert 120 < len(control) < 280
    assert control == rows(C.holdout(many.repartition(3), 10).where("arm = 'control'"), "customer_id")


def test_long_top_list_equals_short(scored, spark):
    candidates = C.eligible(scored, OFFERS)
    short = rows(C.top_k(candidates, 2, ("campaign_id",), "v"))
    assert len(short) == 4
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, 1)
    try:
        assert rows(C.top_k(candidates, 2, ("campaign_id",), "v", single_task_rows=0)) == short
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("k", [10, 999, 1_000, 5_000])
def test_no_task_sorts_a_whole_group_for_a_top_list(scored, k):
    plan = plan_text(C.top_k(C.eligible(scored, OFFERS), k, ("campaign_id",), "v", single_task_rows=0))
    assert ("WindowGroupLimit" in plan) == (k < 1_000)
    assert k < 1_000 or "_global" in plan


def test_export_leaves_no_list_of_an_earlier_run(scored, spark):
    path = work_path(spark, "lists")
    listed = C.eligible(scored, OFFERS)
    first = C.export(listed, path, "2001-02-01")
    again = C.export(listed.where("campaign_id = 'b'"), path, "2001-02-01")
    assert first == again
    assert rows(spark.read.parquet(again).select("campaign_id").distinct()) == [("b",)]
    other = C.export(listed.where("campaign_id = 'a'"), path, "2001-02-02")
    assert rows(spark.read.parquet(other).select("campaign_id").distinct()) == [("a",)]
    assert rows(spark.read.parquet(again).select("campaign_id").distinct()) == [("b",)]


def test_reason_text(spark):
    df = spark.createDataFrame([(1.5, 20.0, 0.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    text = C.reason_text({n: F.col(n) for n in ("a", "b", "c")}, 2)
    assert [r[0] for r in df.select(text).collect()] == ["b:20.00;a:1.50", ""]


def test_overlap(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "customer_id bigint")
    b = spark.createDataFrame([(2,), (3,)], "customer_id bigint")
    assert rows(C.overlap(a, b)) == [(1, "only_a"), (2, "both"), (3, "only_b")]


def test_bands_at_the_cuts(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (49.9,), (75.0,), (None,)], "risk double")
    assert [r["band"] for r in risk.risk_band(df).collect()] == ["low", "medium", "medium", "critical", None]


def test_migration_reports_absent(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x")], "customer_id bigint, segment string")
    b = spark.createDataFrame([(2, "y"), (3, "y")], "customer_id bigint, segment string")
    assert rows(segments.migration(a, b)) == [("absent", "y", 1), ("x", "absent", 1), ("x", "y", 1)]


def test_quintiles_break_ties_by_customer(spark):
    df = spark.createDataFrame([(i, 5, 1, 10) for i in range(10)], "customer_id bigint, recency int, frequency int, monetary int")
    for limit in (0, 1000):
        got = segments.rfm5(df, single_task_rows=limit).orderBy("customer_id").collect()
        assert [r["f5"] for r in got] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
        assert [r["r5"] for r in got] == [r["f5"] for r in got]


def test_lookup_reports_unknown_and_repeated_ids(spark):
    hist = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "two")], "customer_id bigint, snapshot int, s string")
    latest = serving.predictions(hist)
    asked = spark.createDataFrame([(1,), (1,), (9,)], "customer_id bigint")
    assert rows(serving.lookup(latest, asked), "customer_id", "s", "found") == [(1, "new", 1), (1, "new", 1), (9, None, 0)]


def test_suppression_holds_from_its_first_to_its_last_day(scored, spark):
    spans = spark.createDataFrame(
        [
            (1, None, "2001-01-31"), (2, None, "2001-02-01"), (3, "2001-02-01", None), (4, "2001-02-02", None),
            (5, None, None), (6, "2001-01-01", "2001-01-31"), (6, "2001-02-03", "2001-02-03"), (9, None, None), (None, None, None),
        ],
        "customer_id bigint, since string, until string",
    )
    assert rows(C.suppress(scored, spans, "2001-02-01"), "customer_id") == [(1,), (4,), (6,)]
    assert rows(C.suppress(scored, spans, "2001-02-03"), "customer_id") == [(1,), (2,)]
    assert rows(C.suppress(scored, spans), "customer_id") == []
    days = scored.withColumn("day", F.when(F.col("customer_id") == 6, "2001-02-03").otherwise("2001-02-01"))
    assert rows(C.suppress_dated(days, spans), "customer_id") == [(1,), (4,)]
    assert C.suppress_dated(days, spans.limit(0)).count() == 6


def test_overlaps_of_all_lists(scored, spark):
    on = spark.createDataFrame(
        [("a", 1), ("a", 2), ("a", 2), ("b", 2), ("b", 3), ("c", 2), ("z", 1), (None, 1), ("a", None)], "campaign_id string, customer_id bigint"
    )
    want = [("a", "b", 1, 1, 1), ("a", "c", 1, 1, 0), ("a", "empty", 0, 2, 0), ("b", "c", 1, 1, 0), ("b", "empty", 0, 2, 0), ("c", "empty", 0, 1, 0)]
    assert rows(C.overlaps(on, ["a", "b", "c", "empty"])) == want
    assert rows(C.overlaps(on.limit(0), ["a", "b"])) == [("a", "b", 0, 0, 0)]
    assert rows(C.overlaps(on, ["a"])) == []
    many = [f"l{k:02d}" for k in range(63)]
    crowd = spark.range(200).select(F.explode(F.array(*map(F.lit, many))).alias("campaign_id"), F.col("id").alias("customer_id"))
    assert {r[2] for r in rows(C.overlaps(crowd, many))} == {200}
    with pytest.raises(ValueError, match="63"):
        C.overlaps(on, [f"l{k}" for k in range(64)])


def test_the_store_keeps_the_latest_row_and_opens_few_buckets(spark):
    path = work_path(spark, "store")
    day = lambda text, data: spark.createDataFrame(data, "customer_id bigint, risk double, band string").withColumn("snapshot", F.lit(text))
    store.merge_snapshot(spark, path, day("2001-01-01", [(c, float(c), "low") for c in range(200)]), buckets=8)
    # Bigger of two rows of one customer; an older snapshot changes nothing; a null id is nobody.
    store.merge_snapshot(spark, path, day("2001-02-01", [(5, 1.0, "high"), (5, 2.0, "high"), (900, 3.0, None), (None, 1.0, "low")]))
    found = store.merge_snapshot(spark, path, day("2000-01-01", [(6, 9.0, "high"), (901, 1.0, "low")]))
    want = [(c, float(c), "low", "2001-01-01") for c in range(200) if c != 5]
    want += [(5, 2.0, "high", "2001-02-01"), (900, 3.0, None, "2001-02-01"), (901, 1.0, "low", "2000-01-01")]
    got = rows(found, "customer_id", "risk", "band", "snapshot")
    assert got == sorted(want, key=repr)
    asked = spark.createDataFrame([(1, 5), (2, 77), (3, 5), (4, None), (5, 12345)], "request_id bigint, customer_id bigint")
    answered = store.ask(found, asked)
    assert rows(answered, "request_id", "risk", "found") == [(1, 2.0, 1), (2, 77.0, 1), (3, 2.0, 1), (4, None, 0), (5, None, 0)]
    assert rows(answered, *answered.columns) == rows(store.ask(found, asked, most_ids=1), *answered.columns)
    plan = answered._jdf.queryExecution().explainString(answered._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    chosen = [line for line in plan.splitlines() if "SelectedBucketsCount" in line]
    assert chosen and " 8" in chosen[0] and "8 out of 8" not in chosen[0]
    # Merging deals out the new rows only: the stored side is read by its buckets.
    again = store.open_store(spark, path).join(day("2001-03-01", [(1, 1.0, "low")]).repartition(8, "customer_id"), "customer_id", "full")
    assert plan_text(again).count("Exchange hashpartitioning") <= 1
    # What was not finished is not seen; another session finds the same.
    unfinished = f"{path.removeprefix('file:')}/v00000009"
    os.makedirs(unfinished)
    assert rows(store.open_store(spark.newSession(), path), "customer_id", "risk", "band", "snapshot") == got
    with pytest.raises(ValueError, match="no prediction store"):
        store.open_store(spark, work_path(spark, "nothing"))
