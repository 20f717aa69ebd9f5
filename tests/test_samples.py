"""Errors of sampled contributions, stability of clusters, sketches, panels of many snapshots."""

import datetime as dt
import hashlib
import itertools
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from support import SMALL, plan_text, purchases, rows

from lapsewise import sources
from lapsewise.operators import explain, features, models, segments, sketches
from lapsewise.operators.panel import line_panel
from lapsewise.operators.ranking import quantiles


def rand_of(pairs):
    """Adjusted Rand index by counting pairs of rows."""
    same_a = same_b = both = 0
    n = len(pairs)
    for (a, b), (c, d) in itertools.combinations(pairs, 2):
        same_a += a == c
        same_b += b == d
        both += a == c and b == d
    expected = same_a * same_b / (n * (n - 1) / 2)
    most = (same_a + same_b) / 2
    return 1.0 if most == expected else (both - expected) / (most - expected)


@pytest.mark.parametrize("labels", [
    [(k % 3, k % 3 + 7) for k in range(20)], [(k % 3, k % 5) for k in range(30)], [(0, k) for k in range(9)],
    [(0, 0)] * 5, [(k, -k) for k in range(6)], [(None, 1), (None, 1), (2, None), (2, 1)],
])
def test_adjusted_rand_counts_pairs(spark, labels):
    df = spark.createDataFrame(labels, "a int, b int")
    assert rows(segments.adjusted_rand(df, "a", "b")) == [(len(labels), pytest.approx(rand_of(labels)))]


def test_stability_of_groups_and_of_noise(spark):
    noise = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)) / 1000.0
    df = spark.range(400).select(F.col("id").alias("customer_id"), ((F.col("id") % 3) * 50 + noise).alias("x"), noise.alias("y"))
    firm = segments.stability(df, ("x",), 3, resamples=2)
    assert rows(firm, "resample", "rows", F.round("rand", 9)) == [(0, 400, 1.0), (1, 400, 1.0)]
    loose = segments.stability(df, ("y",), 7, resamples=2)
    assert all(r.rand < 0.999 for r in loose.collect())
    assert rows(segments.adjusted_rand(df.limit(0).withColumns({"a": F.lit(1), "b": F.lit(1)}), "a", "b")) == []
    gaps = df.withColumn("x", F.when(F.col("customer_id") % 2 == 0, F.col("x")))
    assert segments.filled(gaps, ("x", "y")).where("x is null or y is null").count() == 0


@pytest.fixture(scope="module")
def linear(spark):
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000.0
    df = spark.range(400).select(
        F.col("id").alias("customer_id"), unit(1).alias("a"), unit(2).alias("b"), unit(3).alias("c"),
        (unit(1) * 2 + unit(2) > 1.5).cast("int").alias("churned"),
    )
    return df, models.fit_logistic(df, ("a", "b", "c"))


def test_errors_cover_the_exact_contributions_of_a_linear_margin(linear):
    df, model = linear
    cols = ("a", "b", "c")
    asked = df.where("customer_id < 60")
    known = explain.background(df, cols, 64)
    got = {(r.customer_id, r.feature): r for r in explain.explain_with_errors(model, asked, cols, known, 0.0, pairs=16, of="margin").collect()}
    # A linear margin's share is w (x - mean): the order plays no part, only the background drawn does.
    exact = {(r.customer_id, r.feature): r.contribution for r in explain.explain_linear(model, asked, cols).collect()}
    assert set(got) == set(exact) and all(r.draws == 64 for r in got.values())
    far = [k for k in got if abs(got[k].contribution - exact[k]) > 3 * got[k].error]
    assert len(far) <= 0.02 * len(got)


def test_rounds_stop_where_errors_are_small(linear):
    df, model = linear
    cols = ("a", "b", "c")
    asked = df.where("customer_id < 40")
    known = explain.background(df, cols, 48)
    done = explain.explain_with_errors(model, asked, cols, known, 0.05, pairs=8)
    per = {}
    for r in done.collect():
        assert r.draws % 8 == 0 and r.draws == per.setdefault(r.customer_id, r.draws)
        assert r.error <= 0.05 or r.draws == 48
    assert len(per) == 40 and len(set(per.values())) > 1
    once = explain.explain_with_errors(model, asked, cols, known, 10.0, pairs=8)
    assert {r.draws for r in once.collect()} == {8}
    # What is added up is the way from the background to the customer.
    sums = {r.customer_id: r.s for r in once.groupBy("customer_id").agg(F.sum("contribution").alias("s")).collect()}
    p = {r.customer_id: r.probability for r in models.score(model, asked, cols).collect()}
    assert len({round(p[c] - sums[c], 9) for c in p}) == 1
    assert not rows(explain.explain_with_errors(model, asked.limit(0), cols, known, 0.1))
    assert not rows(explain.explain_with_errors(model, asked, cols, known.limit(0), 0.1))


def test_pairs_of_orders_vary_less(linear):
    df, model = linear
    cols = ("a", "b", "c")
    asked = df.where("customer_id < 30")
    one = explain.background(df, cols, 1)
    many = one
    for _ in range(4):
        many = many.union(many)
    # One background only: what is left is the chance of the order, which its reverse evens out.
    paired = explain.explain_with_errors(model, asked, cols, many, 0.0, pairs=16)
    exact = {}
    known = explain._as_array(one, cols)
    for order in itertools.permutations(cols):
        draws = explain._draws(asked, cols, known, "x").withColumn("_order", F.array(*map(F.lit, order)))
        for r in explain._switched(model, draws, cols, "probability").groupBy("customer_id", "feature").agg(F.sum("v").alias("v")).collect():
            exact[r.customer_id, r.feature] = exact.get((r.customer_id, r.feature), 0.0) + r.v / 6
    worst = [abs(r.contribution - exact[r.customer_id, r.feature]) - 4 * r.error for r in paired.collect()]
    assert max(worst) < 1e-6 or sum(w > 1e-6 for w in worst) <= 0.05 * len(worst)


def test_switches_are_dealt_to_all_tasks_and_compiled(linear):
    """One file of customers keeps every task busy; what a draw fixes is not worked out at every step."""
    df, model = linear
    cols = ("a", "b", "c")
    known = explain.background(df, cols, 4)
    one_task = df.coalesce(1)
    draws = explain._draws(one_task, cols, explain._as_array(known, cols), "order")
    got = draws.select("customer_id", "_perm", "_order", F.spark_partition_id().alias("task")).collect()
    assert len(got) == 1600 and len({r.task for r in got}) == 8
    for r in got:
        drawn = sorted(cols, key=lambda c: hashlib.md5(f"order:{r.customer_id}:{r._perm}:{c}".encode()).hexdigest())
        assert r._order == drawn
    plan = plan_text(explain.explain_sampled(model, one_task, cols, known))
    assert "Generate explode" in plan and "array_position" in plan and "lambda" not in plan
    assert "array_position" not in plan.split("Generate explode")[0]


def test_sketches_stay_within_their_error(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 30).alias("day"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("x"),
        F.when(F.col("id") % 3 == 0, (F.col("id") % 10).cast("double")).alias("ties"), F.lit(None).cast("double").alias("none"),
    )
    k = 200
    kept = sketches.daily_sketches(df, "day", ["x", "ties", "none"], k)
    assert kept.count() == 40  # ties lie on every third day
    probs = [0.0, 0.01, 0.2, 0.5, 0.9, 1.0]
    got = {(r.feature, r.prob): r for r in sketches.sketched_quantiles(kept, probs, k=k).collect()}
    assert got["x", 0.5].n == 60_000 and got["ties", 0.5].n == 20_000
    for p in probs:
        rank = df.where(F.col("x") <= got["x", p].value).count() / 60_000
        assert abs(rank - p) <= sketches.rank_error(k) + 1e-4
        assert got["ties", p].value == pytest.approx(min(9, math.floor(p * 10)), abs=1)
    some = sketches.sketched_quantiles(kept.where("day < 2"), [0.5], ["day"], k)
    assert rows(some, "day", "feature", "n") == [(0, "ties", 2000), (0, "x", 2000), (1, "x", 2000)]
    limits = sketches.sketched_limits(kept, ["x"], 0.05, 0.95, k)
    clipped = features.winsorize(df, ["x"], limits)
    low, high = clipped.agg(F.min("x"), F.max("x")).first()
    exact = {r.prob: r.value for r in quantiles(df, ["x"], [0.05 - 0.02, 0.05 + 0.02, 0.95 - 0.02, 0.95 + 0.02]).collect()}
    bounds = sorted(exact.values())
    assert bounds[0] <= low <= bounds[1] and bounds[2] <= high <= bounds[3]
    assert not rows(sketches.sketched_quantiles(sketches.daily_sketches(df.limit(0), "day", ["x"]), [0.5]))


def test_line_panel_of_a_thousand_snapshots(spark):
    """Every state against sums over the lines so far; one type is unknown, one part has no record."""
    first = dt.date(2001, 1, 1)
    snaps = [first + dt.timedelta(days=n) for n in range(1_000)]
    bought = [(1, n, str(first + dt.timedelta(days=7 * n)), 1.0) for n in range(60)] + [(2, 100 + n, "2001-03-01", 1.0) for n in range(3)]
    lines = [(o, o % 7, 100 * (1 + o % 4), 500, "N") for _, o, _, _ in bought] + [(0, 3, 100, 0, "N"), (5, None, 100, 0, "N")]
    kinds = {0: "PROMO", 1: "ECONOMY", 2: "odd", 3: "PROMO", 4: None, 5: "STANDARD"}
    got = line_panel(
        purchases(spark, bought), spark.createDataFrame(lines, "order_id bigint, part_id bigint, quantity_hundredths bigint, discount_bp bigint, return_flag string"),
        spark.createDataFrame(list(kinds.items()), "part_id bigint, part_type string"), snaps,
    )
    table = {(r.snapshot, r.customer_id): r for r in got.collect()}
    day = {o: dt.date.fromisoformat(d) for _, o, d, _ in bought}
    owner = {o: c for c, o, _, _ in bought}
    for snap in (*snaps[:12], snaps[70], snaps[400], snaps[999]):
        for customer in (1, 2):
            mine = [x for x in lines if owner[x[0]] == customer and day[x[0]] < snap]
            if not mine:
                assert (snap, customer) not in table
                continue
            r = table[snap, customer]
            by = Counter()
            for _, part, quantity, _, _ in mine:
                by[kinds.get(part)] += quantity
            total = sum(by.values())
            assert (r.lines, float(r.quantity), r.distinct_parts) == (len(mine), total / 100, len({x[1] for x in mine} - {None}) + (None in {x[1] for x in mine}))
            assert r.share_promo == pytest.approx(by["PROMO"] / total)
            assert r.share_other == pytest.approx(1 - sum(by[t] for t in features.PART_TYPES) / total)
            assert r.mix_entropy == pytest.approx(-sum(q / total * math.log(q / total) for q in by.values()), abs=1e-9)
            assert r.favourite_type == min(by, key=lambda t: (-by[t], t is None, t or ""))


def test_line_panel_of_one_snapshot_is_the_mix(spark):
    inputs = (sources.purchases(spark, SMALL), sources.lines(spark, SMALL), sources.parts(spark, SMALL))
    shares = [f"share_{t.lower()}" for t in (*features.PART_TYPES, "other")]
    cols = ("customer_id", *[F.round(c, 9) for c in (*shares, "mix_entropy")], "favourite_type")
    assert rows(line_panel(*inputs, ["2001-02-01"]), *cols) == rows(features.mix(*inputs, "2001-02-01"), *cols)
