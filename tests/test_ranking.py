"""The ranking over ranges equals the plain window, hot groups and ties included."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from support import plan_text, rows

from lapsewise.functions import ntile_of
from lapsewise.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, half of all values tied."""
    rng = random.Random(3)
    data = []
    for i in range(4000):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(200)}"
        value = 0 if rng.random() < 0.5 else rng.randrange(1000)
        data.append((i, group, value, rng.randrange(500)))
    return spark.createDataFrame(data, "id bigint, grp string, value bigint, amount bigint").repartition(6)


@pytest.mark.parametrize("by", [(), ("grp",)])
def test_ranges_equal_plain_window(skewed, by):
    order = [F.col("value").desc(), F.col("id")]
    got = ranking.global_rank(skewed, order, by, ["amount"], single_task_rows=0)
    group = W.partitionBy(*by)
    run = group.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    want = skewed.select(
        "*",
        F.row_number().over(group.orderBy(*order)).alias("rn"),
        F.count("*").over(group).alias("rn_rows"),
        F.sum("amount").over(run).alias("run_amount"),
        F.sum("amount").over(group).alias("all_amount"),
    )
    assert rows(got) == rows(want)


@pytest.mark.parametrize("by", [(), ("grp",)])
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.none() | st.integers(-3, 3), st.none() | st.integers(-5, 5)),
        max_size=40,
    )
)
def test_nulls_in_ranked_and_summed_columns(spark, by, data):
    """NULL adds nothing: at the start of a range, of a group, or of everything."""
    made = [(i, *r) for i, r in enumerate(data)]
    df = spark.createDataFrame(made, "id bigint, grp string, value bigint, amount bigint").repartition(4)
    order = [F.col("value").desc(), F.col("id")]
    got = ranking.global_rank(df, order, by, ["amount"], single_task_rows=0)
    want = ranking.global_rank(df, order, by, ["amount"], at_most=40)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("by", [(), ("grp",)])
def test_a_range_may_begin_with_nulls(spark, by):
    made = [(i, "g" if i < 900 else "h", i, None if i % 100 < 60 else i) for i in range(1200)]
    df = spark.createDataFrame(made, "id bigint, grp string, value bigint, amount bigint").repartition(4)
    got = ranking.global_rank(df, [F.col("id")], by, ["amount"], single_task_rows=0)
    assert rows(got) == rows(ranking.global_rank(df, [F.col("id")], by, ["amount"], at_most=1200))


def test_nan_is_the_largest_value(spark):
    made = [(i, float("nan") if i % 7 == 0 else float(i % 5), 1) for i in range(300)]
    df = spark.createDataFrame(made, "id bigint, value double, amount bigint").repartition(4)
    order = [F.col("value"), F.col("id")]
    got, want = (
        {r["id"]: (r["rn"], r["run_amount"]) for r in ranking.global_rank(df, order, (), ["amount"], at_most=n, single_task_rows=k).collect()}
        for n, k in ((None, 0), (300, None))
    )
    assert got == want


def test_ranges_are_balanced(skewed):
    """No range holds much more than its part, though one group and one value dominate."""
    order = [F.col("value"), F.col("id")]
    done = ranking.global_rank(skewed, order, ["grp"], single_task_rows=0)
    assert done.where("grp = 'hot'").agg(F.max("rn")).first()[0] == 1334
    assert "SinglePartition" not in plan_text(done.select("id", "rn", "rn_rows").where("rn = 1")).split("Window")[0]


def test_size_switch(skewed):
    order = [F.col("id")]
    plain = ranking.global_rank(skewed, order, at_most=4000)
    assert "rangepartitioning" not in plan_text(plain)
    assert rows(plain) == rows(ranking.global_rank(skewed, order, at_most=4000, single_task_rows=100))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 200), st.integers(1, 12))
def test_ntile_sizes(n, k):
    def tile(rn):
        small, extra = divmod(n, k)
        head = extra * (small + 1)
        return -(-rn // (small + 1)) if rn <= head else extra - (-(rn - head) // max(small, 1))

    sizes = [sum(tile(rn) == t for rn in range(1, n + 1)) for t in range(1, k + 1)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("k", [1, 3, 7, 10])
def test_ntile_expression(spark, k):
    for n in (1, 2, 9, 10, 11, 50):
        df = spark.range(1, n + 1).select(
            F.col("id"), ntile_of(F.col("id"), F.lit(n), k).alias("got"),
            F.ntile(k).over(W.orderBy("id")).alias("want"),
        )
        assert df.where("got <> want").count() == 0


def test_percent_ranks(skewed):
    got = ranking.percent_ranks(
        skewed, {"pr": ("value", ()), "grp_pr": ("value", ["grp"])}, single_task_rows=0
    )
    want = skewed.select(
        "*",
        F.percent_rank().over(W.orderBy("value")).alias("pr"),
        F.percent_rank().over(W.partitionBy("grp").orderBy("value")).alias("grp_pr"),
    )
    assert rows(got) == rows(want)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.sampled_from([0, 1000]))
def test_quantiles(spark, values, limit):
    df = spark.createDataFrame([(v, None if v == 5 else v * 2) for v in values], "a bigint, b bigint")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = ranking.quantiles(df, ["a", "b"], probs, single_task_rows=limit)
    found = {(r["feature"], r["prob"]): r["value"] for r in got.collect()}
    exact = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in ("a", "b")]).first()
    for c in ("a", "b"):
        for i, p in enumerate(probs):
            if exact[c] is None:
                assert (c, p) not in found
            else:
                assert found[(c, p)] == pytest.approx(exact[c][i])


@pytest.mark.parametrize("by", [(), ("grp",)])
@pytest.mark.parametrize("k", [2, 5, 40])
def test_ntiles_by_cuts_equal_window(skewed, by, k):
    """Groups smaller than k and NULL values included."""
    df = skewed.withColumn("value", F.expr("nullif(value, 7)"))
    tiles = {"up": [("value", True), ("id", True)], "down": [("value", False), ("id", True)]}
    got = ranking.ntiles(df, tiles, k, by, single_task_rows=0)
    group = W.partitionBy(*by)
    want = df.select(
        "*",
        F.ntile(k).over(group.orderBy(F.col("value").asc(), "id")).alias("up"),
        F.ntile(k).over(group.orderBy(F.col("value").desc(), "id")).alias("down"),
    )
    assert rows(got) == rows(want)
