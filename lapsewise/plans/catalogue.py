"""Registered queries: each takes a session and a table folder and returns one result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise import sources as S
from lapsewise.functions import iso, ntile_of
from lapsewise.operators import behaviour, campaigns, evaluation, explain, features, labels, matching, models
from lapsewise.operators import prepare, quality, ranking, risk, segments, serving, sketches, store
from lapsewise.operators.facts import as_of, facts
from lapsewise.operators.panel import line_panel, panel
from lapsewise.plans import churn
from lapsewise.plans.churn import CAMPAIGNS, DAY, HORIZON, SNAPSHOTS, WISHES, Inputs
from lapsewise.session import configure, freeze, work_path
from lapsewise import streaming
from lapsewise.streaming import kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINEAR_WEIGHTS = {"recency": 0.004, "frequency": -0.08, "monetary": -0.0000005, "tenure": 0.0002}
CLUSTER_COLUMNS = ("recency", "frequency", "monetary")


def query(fn: Query) -> Query:
    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    prepared.__name__ = fn.__name__
    QUERIES[fn.__name__] = prepared
    return fn


def typed(df: DataFrame, **types: str) -> DataFrame:
    """Columns in the given order and type; ``double:n`` also rounds to n digits."""
    out = []
    for name, kind in types.items():
        base, _, digits = kind.partition(":")
        col = F.col(name).cast(base)
        out.append((F.round(col, int(digits)) if digits else col).alias(name))
    return df.select(*out)


def buyers_at_most(spark, folder) -> int:
    """Bound on the customers with orders: the orders, counted from file footers."""
    return S.load(spark, folder, "orders").count()


def people_at_most(spark, folder) -> int:
    return S.load(spark, folder, "customer").count()


def same(names: Sequence[str], kind: str) -> dict[str, str]:
    return {n: kind for n in names}


RFM_TYPES = {
    "customer_id": "bigint", "recency": "bigint", "frequency": "bigint", "monetary": "double",
    "mean_order": "double", "tenure": "bigint",
}
GAP_TYPES = {
    "mean_gap": "double", "sd_gap": "double:6", "max_gap": "double", "recency_to_gap": "double:9",
}
TRAILING_TYPES = {
    f"{kind}_{n}": t
    for n in features.WINDOWS
    for kind, t in (("orders", "bigint"), ("spend", "double"))
}
TREND_TYPES = {"spend_trend": "double", "spend_slope": "double:7"}
BASKET_TYPES = {
    "lines": "double", "quantity": "double", "distinct_parts": "double", "mean_discount": "double",
}
MIX_TYPES = {
    **{f"share_{t.lower()}": "double" for t in (*features.PART_TYPES, "other")},
    "mix_entropy": "double:6",
    "favourite_type": "string",
}
SCORED_TYPES = {
    "customer_id": "bigint", "recency": "bigint", "frequency": "bigint", "monetary": "double",
    "r5": "bigint", "f5": "bigint", "m5": "bigint", "segment": "string", "risk": "double",
    "band": "string", "value_at_risk": "double", "churned": "bigint",
}


# Ingestion and quality


@query
def d1_load_parquet(spark, folder):
    return S.load(spark, folder, "customer")


def _round_trip(spark, folder, table, fmt):
    path = work_path(spark, "load")
    S.save(S.load(spark, folder, table), f"{path}/{table}.{fmt}", fmt=fmt)
    return S.load(spark, path, table, fmt).withColumn("corrupt", F.col(S.CORRUPT).isNotNull()).drop(S.CORRUPT)


@query
def d1_load_csv(spark, folder):
    df = _round_trip(spark, folder, "orders", "csv")
    return df.withColumn("o_orderdate", iso("o_orderdate"))


@query
def d1_load_json(spark, folder):
    return _round_trip(spark, folder, "part", "json")


@query
def d2_conform(spark, folder):
    mapping = {**S.PURCHASE, "amount": S.Target("o_totalprice", "decimal(7,2)")}
    done = S.conform(S.load(spark, folder, "orders"), mapping)
    return done.select(
        "order_id", "customer_id", iso("order_ts").alias("order_day"),
        F.col("amount").cast("double").alias("amount"), "bad_fields",
    )


ORDER_RULES = {
    "amount_in_range": "o_totalprice between 1000 and 450000",
    "known_status": "o_orderstatus in ('F', 'O')",
    "urgent_is_closed": "o_orderpriority <> '1-URGENT' or o_orderstatus = 'F'",
}


def _violations(spark, folder):
    return quality.validate(S.load(spark, folder, "orders"), "orders", "o_orderkey", ORDER_RULES)


@query
def d3_validate(spark, folder):
    return _violations(spark, folder)


@query
def d3_violation_counts(spark, folder):
    return quality.violation_counts(_violations(spark, folder))


PROP_RULES = {
    "k_in_range": quality.PathRule("$.k", "int", "value between 0 and 89"),
    "k_not_of_seven": quality.PathRule("$.k", "int", "value % 7 <> 3"),
    "tag_is_known": quality.PathRule("$.tag", "string", "value in ('a', 'b')", required=False),
    "parts_are_there": quality.PathRule("$.parts[0].id", "int"),
}


@query
def d3_json_rules(spark, folder):
    """Rules on paths of the events' properties; every 50th text is cut, every 20th has more in it."""
    events = S.load(spark, folder, "events").withColumn(
        "props",
        F.when(F.col("event_id") % 50 == 0, F.substring("props", 1, 4))
        .when(F.col("event_id") % 20 == 1, F.concat(F.lit('{"parts": [{"id": 7}], "tag": "c", '), F.expr("substring(props, 2)")))
        .otherwise(F.col("props")),
    )
    return quality.validate_json(events, "events", "event_id", "props", PROP_RULES)


@query
def d4_fk_check(spark, folder):
    orders = S.load(spark, folder, "orders")
    users = S.load(spark, folder, "events").select("user_id").distinct()
    return quality.fk_check(orders, "o_custkey", users, "user_id")


def _known(spark, folder):
    """Customers that raised an event: records of another table, which lacks some."""
    seen = S.load(spark, folder, "events").select(F.col("user_id").alias("customer_id")).distinct()
    return S.customers(spark, folder).join(seen, "customer_id", "left_semi")


def _purchase_rows(df):
    return df.select(
        "customer_id", "order_id", iso("order_ts").alias("order_day"),
        (F.col("cents") / 100.0).alias("amount"),
    )


@query
def d5_missing_drop(spark, folder):
    return _purchase_rows(
        quality.handle_missing(S.purchases(spark, folder), _known(spark, folder), "drop")
    )


@query
def d5_missing_quarantine(spark, folder):
    return _purchase_rows(
        quality.handle_missing(S.purchases(spark, folder), _known(spark, folder), "quarantine")
    )


@query
def d5_missing_placeholder(spark, folder):
    done = quality.handle_missing(S.purchases(spark, folder), _known(spark, folder), "placeholder")
    return typed(
        done, customer_id="bigint", nation_id="double", market_segment="string", balance="double",
        placeholder="int",
    )


@query
def d6_key_check(spark, folder):
    return quality.key_check(S.load(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def _facts(spark, folder):
    i = Inputs(spark, folder)
    return facts(i.purchases, i.lines, i.customers, i.places)


FACT_TYPES = {
    "order_id": "bigint", "customer_id": "bigint", "order_day": "string", "amount": "double",
    "lines": "double", "quantity": "double", "market_segment": "string", "nation": "string",
    "region": "string",
}


@query
def d7_save(spark, folder):
    path = work_path(spark, "facts")
    rows = S.purchases(spark, folder).withColumn("order_year", F.year("order_ts"))
    S.save(rows, path, ("order_year",))
    return spark.read.parquet(path).select(
        "customer_id", "order_id", iso("order_ts").alias("order_day"),
        (F.col("cents") / 100.0).alias("amount"), F.col("order_year").cast("bigint").alias("order_year"),
    )


@query
def d8_facts(spark, folder):
    return typed(
        _facts(spark, folder).select(
            "*", iso("order_ts").alias("order_day"), (F.col("cents") / 100.0).alias("amount")
        ),
        **FACT_TYPES,
    )


# Behaviour


@query
def a1_by_period(spark, folder):
    done = behaviour.by_period(S.purchases(spark, folder)).withColumn("period", iso("period"))
    return typed(
        done, period="string", orders="bigint", customers="bigint", revenue="double", growth="double"
    )


@query
def a2_cohorts(spark, folder):
    done = behaviour.cohorts(S.purchases(spark, folder)).withColumn("cohort", iso("cohort"))
    return typed(done, cohort="string", age="bigint", customers="bigint", retention="double")


@query
def a3_rollup_report(spark, folder):
    i = Inputs(spark, folder)
    base = features.snapshot(i.purchases, DAY, HORIZON).join(i.people(), "customer_id")
    done = behaviour.rollup_report(base, ["region", "nation", "market_segment"])
    return typed(
        done, region="string", nation="string", market_segment="string", level="bigint",
        customers="bigint", revenue="double", churn_rate="double",
    )


@query
def a4_concentration(spark, folder):
    done = behaviour.concentration(
        features.rfm(S.purchases(spark, folder), DAY), at_most=buyers_at_most(spark, folder)
    )
    return typed(
        done, decile="bigint", customers="bigint", held="double", share="double",
        cumulative_share="double",
    )


# Features


@query
def f1_as_of(spark, folder):
    return _purchase_rows(as_of(S.purchases(spark, folder), DAY))


@query
def f2_rfm(spark, folder):
    return typed(features.rfm(S.purchases(spark, folder), DAY), **RFM_TYPES)


@query
def f3_gaps(spark, folder):
    done = features.gaps(S.purchases(spark, folder), DAY)
    return typed(done, customer_id="bigint", **GAP_TYPES)


@query
def f4_trailing(spark, folder):
    return typed(features.trailing(S.purchases(spark, folder), DAY), customer_id="bigint", **TRAILING_TYPES)


@query
def f5_trend(spark, folder):
    return typed(features.trend(S.purchases(spark, folder), DAY), customer_id="bigint", **TREND_TYPES)


@query
def f6_basket(spark, folder):
    i = Inputs(spark, folder)
    return typed(features.basket(i.purchases, i.lines, DAY), customer_id="bigint", **BASKET_TYPES)


@query
def f7_mix(spark, folder):
    i = Inputs(spark, folder)
    return typed(features.mix(i.purchases, i.lines, i.parts, DAY), customer_id="bigint", **MIX_TYPES)


@query
def f8_returns(spark, folder):
    i = Inputs(spark, folder)
    return typed(features.returns(i.purchases, i.lines, DAY), customer_id="bigint", return_share="double")


def _placed_rfm(spark, folder):
    i = Inputs(spark, folder)
    return features.rfm(i.purchases, DAY).join(i.people(), "customer_id")


@query
def f9_peer(spark, folder):
    done = features.peer(_placed_rfm(spark, folder), ["monetary", "recency"], "nation")
    return typed(
        done, customer_id="bigint", nation="string", monetary_z="double:6", recency_z="double:6",
        monetary_pr="double", recency_pr="double",
    )


@query
def f10_running_spend(spark, folder):
    done = features.running_spend(S.purchases(spark, folder), 90)
    return typed(done, order_id="bigint", customer_id="bigint", spend_window="double")


def _split(df):
    df = labels.split_by_key(df)
    return df, df.where("split = 'train'")


@query
def f11_impute(spark, folder):
    df, train = _split(features.gaps(S.purchases(spark, folder), DAY))
    values = features.impute_values(train, {"mean_gap": "mean", "sd_gap": "median", "max_gap": 0}, buyers_at_most(spark, folder))
    done = features.impute(df, values)
    return typed(
        done, customer_id="bigint", mean_gap="double:6", sd_gap="double:6", max_gap="double",
        mean_gap_missing="bigint", sd_gap_missing="bigint", max_gap_missing="bigint",
    )


@query
def f12_winsorize(spark, folder):
    df, train = _split(features.rfm(S.purchases(spark, folder), DAY))
    cols = ["monetary", "recency"]
    done = features.winsorize(
        df, cols, features.winsor_limits(train, cols, at_most=buyers_at_most(spark, folder))
    )
    return typed(done, customer_id="bigint", monetary="double:6", recency="double:6")


SKETCH_PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query
def f12_sketches(spark, folder):
    """Quantiles of order amounts and sizes merged from a sketch per day, between the exact quantiles at
    the stated rank error below and above."""
    orders, rows = freeze(S.purchases(spark, folder).select(F.to_date("order_ts").alias("day"), (F.col("cents") / 100.0).alias("amount"), "order_id"))
    path = work_path(spark, "sketches")
    for late in (False, True):  # a table that grows by days
        some = orders.where((F.col("day") >= F.lit(DAY).cast("date")) == F.lit(late))
        sketches.daily_sketches(some, "day", ["amount"]).write.mode("append").parquet(path)
    found = sketches.sketched_quantiles(spark.read.parquet(path), SKETCH_PROBS)
    error = sketches.rank_error()
    probs = sorted({min(1.0, max(0.0, p + d)) for p in SKETCH_PROBS for d in (-error, 0.0, error)})
    exact, _ = freeze(ranking.quantiles(orders, ["amount"], probs, (), rows))
    of = lambda d, name: exact.select(
        F.col("feature").alias(f"_f{name}"), F.col("prob").alias(f"_p{name}"), F.col("value").alias(name)
    )
    for d, name in ((-error, "low"), (0.0, "exact"), (error, "high")):
        wanted = F.least(F.greatest(F.col("prob") + F.lit(d), F.lit(0.0)), F.lit(1.0))
        found = found.join(of(d, name), (F.abs(wanted - F.col(f"_p{name}")) < 1e-12) & (F.col("feature") == F.col(f"_f{name}")))
    inside = F.col("value").between(F.col("low"), F.col("high"))
    return typed(
        found.withColumn("within", inside), feature="string", prob="double", n="bigint", exact="double:6", low="double:6", high="double:6", within="bigint"
    )


@query
def f13_encode(spark, folder):
    df, train = _split(_placed_rfm(spark, folder))
    done = features.encode(df, ["market_segment", "region"], train)
    return typed(
        done, customer_id="bigint", market_segment="string", market_segment_index="bigint",
        region="string", region_index="bigint",
    )


@query
def f14_standardize(spark, folder):
    df, train = _split(features.rfm(S.purchases(spark, folder), DAY))
    cols = ["recency", "frequency", "monetary"]
    done = features.standardize(df, cols, features.moments(train, cols))
    return typed(done, customer_id="bigint", **same(cols, "double:6"))


@query
def f15_panel(spark, folder):
    done = panel(S.purchases(spark, folder), SNAPSHOTS, HORIZON).withColumn("snapshot", iso("snapshot"))
    return typed(
        done, snapshot="string", **RFM_TYPES, **GAP_TYPES, **TREND_TYPES,
        orders_180="bigint", spend_180="double", orders_365="bigint", spend_365="double",
        churned="bigint",
    )


@query
def f15_line_panel(spark, folder):
    i = Inputs(spark, folder)
    done = line_panel(i.purchases, i.lines, i.parts, SNAPSHOTS).withColumn("snapshot", iso("snapshot"))
    return typed(done, snapshot="string", customer_id="bigint", **BASKET_TYPES, **MIX_TYPES)


@query
def f16_feature_table(spark, folder):
    done = churn.feature_table(Inputs(spark, folder))
    return typed(
        done, **RFM_TYPES, **GAP_TYPES, **TRAILING_TYPES, **TREND_TYPES, **BASKET_TYPES, **MIX_TYPES,
        market_segment="string", nation="string", region="string",
    )


# Labels and splits


@query
def l1_churn_label(spark, folder):
    done = labels.churn_label(S.purchases(spark, folder), DAY, HORIZON)
    return typed(done, customer_id="bigint", churned="bigint")


@query
def l2_guard(spark, folder):
    done = labels.guard(S.purchases(spark, folder), [*SNAPSHOTS, "2001-03-01"], HORIZON)
    return typed(done, snapshot="string", window_end="string", data_end="string", censored="bigint")


@query
def l3_split_by_key(spark, folder):
    done = labels.split_by_key(labels.churn_label(S.purchases(spark, folder), DAY, HORIZON))
    return typed(done, customer_id="bigint", split="string")


@query
def l3_split_by_time(spark, folder):
    rows = panel(S.purchases(spark, folder), SNAPSHOTS, HORIZON)
    done = labels.split_by_time(rows, SNAPSHOTS[-1]).withColumn("snapshot", iso("snapshot"))
    return typed(done, snapshot="string", customer_id="bigint", churned="bigint", split="string")


@query
def l4_class_weight(spark, folder):
    done = labels.class_weight(labels.churn_label(S.purchases(spark, folder), DAY, HORIZON))
    return typed(done, customer_id="bigint", churned="bigint", weight="double")


# Risk and segments


def _scored(spark, folder):
    return churn.scored_customers(Inputs(spark, folder))


def _quintiled(spark, folder):
    rfm = features.rfm(S.purchases(spark, folder), DAY)
    return segments.rfm5(rfm, at_most=buyers_at_most(spark, folder))


@query
def lapse_report(spark, folder):
    return typed(_scored(spark, folder), **SCORED_TYPES)


@query
def r2_rule_risk(spark, folder):
    quintiled = _quintiled(spark, folder)
    return typed(risk.rule_risk(quintiled), customer_id="bigint", risk="double")


@query
def r3_risk_band(spark, folder):
    quintiled = _quintiled(spark, folder)
    done = risk.risk_band(risk.rule_risk(quintiled))
    return typed(done.groupBy("band").agg(F.count("*").alias("customers")), band="string", customers="bigint")


@query
def r4_value_at_risk(spark, folder):
    done = risk.value_at_risk_by(_scored(spark, folder), ["region", "market_segment"])
    return typed(
        done, region="string", market_segment="string", customers="bigint", value_at_risk="double"
    )


@query
def r5_risk_rank(spark, folder):
    done = risk.risk_rank(_scored(spark, folder), at_most=people_at_most(spark, folder))
    return typed(
        done, customer_id="bigint", overall_rank="bigint", overall_pr="double", region_pr="double"
    )


@query
def g1_rfm5(spark, folder):
    done = _quintiled(spark, folder)
    return typed(done, customer_id="bigint", r5="bigint", f5="bigint", m5="bigint")


@query
def g2_rule_segment(spark, folder):
    quintiled = _quintiled(spark, folder)
    done = segments.rule_segment(quintiled).groupBy("segment").agg(F.count("*").alias("customers"))
    return typed(done, segment="string", customers="bigint")


@query
def g3_kmeans(spark, folder):
    rfm = features.rfm(S.purchases(spark, folder), DAY).select("customer_id", *CLUSTER_COLUMNS)
    frozen, _ = freeze(rfm)
    return segments.kmeans(frozen, CLUSTER_COLUMNS, 5)[1].select("customer_id", "cluster")


@query
def g4_choose_k(spark, folder):
    rfm = features.rfm(S.purchases(spark, folder), DAY)
    return segments.choose_k(rfm, CLUSTER_COLUMNS, (2, 3, 4, 5))


def _apart(spark, folder):
    """Customers as points that lie close together within a region and far from other regions."""
    people = Inputs(spark, folder).customers.join(Inputs(spark, folder).places, "nation_id")
    table, _ = freeze(
        people.select(
            "customer_id", "region", F.length("region").cast("double").alias("x"), F.ascii("region").cast("double").alias("y"),
            (F.ascii(F.substring("region", 2, 1)) % 7 + F.coalesce(F.col("balance").cast("double"), F.lit(0.0)) / 1e6).alias("z"),
        )
    )
    return table, ("x", "y", "z")


@query
def g3_regions(spark, folder):
    """Clusters are named by their smallest member, since their numbers mean nothing."""
    table, cols = _apart(spark, folder)
    done = segments.kmeans(table, cols, 5)[1]
    first = done.groupBy("cluster").agg(F.min("customer_id").alias("group_id"), F.count(F.lit(1)).alias("customers"))
    return typed(done.join(first, "cluster"), customer_id="bigint", group_id="bigint", customers="bigint")


@query
def g4_regions(spark, folder):
    table, cols = _apart(spark, folder)
    return typed(segments.choose_k(table, cols, (2, 3, 4, 5, 6)).where("best = 1"), k="bigint", best="bigint")


@query
def g3_adjusted_rand(spark, folder):
    scored, _ = freeze(_scored(spark, folder))
    pairs = (("segment", "band"), ("region", "segment"), ("r5", "r5"))
    found = [segments.adjusted_rand(scored, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "rows", "rand") for a, b in pairs]
    return typed(found[0].union(found[1]).union(found[2]), a="string", b="string", rows="bigint", rand="double:9")


@query
def g3_stability(spark, folder):
    """Clusters on all columns of the models, missing ones filled."""
    table = segments.filled(churn.feature_table(Inputs(spark, folder)), churn.MODEL_COLUMNS)
    return segments.stability(table, churn.MODEL_COLUMNS, 4, resamples=3)


@query
def g5_profile(spark, folder):
    cols = ["recency", "frequency", "monetary"]
    done = segments.profile(_scored(spark, folder), "segment", cols)
    return typed(
        done, segment="string", customers="bigint", share="double", churn_rate="double",
        mean_recency="double", mean_frequency="double", mean_monetary="double",
        median_recency="double", median_frequency="double", median_monetary="double:6",
    )


@query
def g6_migration(spark, folder):
    past, _ = freeze(churn.history(Inputs(spark, folder), (SNAPSHOTS[0], SNAPSHOTS[-1])))
    first, last = (past.where(F.col("snapshot") == F.lit(s).cast("date")) for s in (SNAPSHOTS[0], SNAPSHOTS[-1]))
    done = segments.migration(first, last)
    return typed(done, segment_before="string", segment_after="string", customers="bigint")


@query
def g7_cross_tab(spark, folder):
    done = segments.cross_tab(_scored(spark, folder))
    return typed(
        done, segment="string", band="string", all_segment="bigint", all_band="bigint",
        customers="bigint", value_at_risk="double",
    )


# Campaigns


CANDIDATE_TYPES = {
    "campaign_id": "string", "customer_id": "bigint", "priority": "int", "cost": "double",
    "value_at_risk": "double",
}


def _eligible(spark, folder):
    return campaigns.eligible(_scored(spark, folder), CAMPAIGNS)


def _assigned(spark, folder):
    return campaigns.assign(_scored(spark, folder), CAMPAIGNS)


@query
def c1_eligible(spark, folder):
    return typed(_eligible(spark, folder), **CANDIDATE_TYPES)


@query
def c2_suppress(spark, folder):
    excluded = campaigns.recent_buyers(S.purchases(spark, folder), DAY, 14)
    return typed(campaigns.suppress(_eligible(spark, folder), excluded), **CANDIDATE_TYPES)


def _contacts(spark, folder):
    """Every order keeps its customer from being contacted for 30 days; some customers opted out."""
    ordered = S.purchases(spark, folder).select(
        "customer_id", F.to_date("order_ts").alias("since"), F.date_add(F.to_date("order_ts"), 30).alias("until")
    )
    opted = S.customers(spark, folder).where("customer_id % 13 = 0").select(
        "customer_id", F.lit(None).cast("date").alias("since"), F.lit(None).cast("date").alias("until")
    )
    return ordered.union(opted)


@query
def c2_suppress_until(spark, folder):
    done = campaigns.suppress(_eligible(spark, folder), _contacts(spark, folder), DAY)
    return typed(done, **CANDIDATE_TYPES)


@query
def c2_suppress_dated(spark, folder):
    """Each candidate on one of sixty days, which its own id says."""
    days = F.date_add(F.lit(DAY).cast("date"), (F.col("customer_id") % 60).cast("int") - 40)
    done = campaigns.suppress_dated(_eligible(spark, folder).withColumn("day", days), _contacts(spark, folder))
    return typed(done.withColumn("day", iso("day")), **CANDIDATE_TYPES, day="string")


@query
def c3_assign(spark, folder):
    return typed(_assigned(spark, folder), **CANDIDATE_TYPES)


MATCH_TYPES = {"campaign_id": "string", "customer_id": "bigint", "place": "bigint", "cost": "double", "spent": "double"}


@query
def c3_match(spark, folder):
    done = matching.match(_scored(spark, folder), CAMPAIGNS, at_most=people_at_most(spark, folder))
    return typed(done, **MATCH_TYPES)


@query
def c3_match_wishes(spark, folder):
    done = matching.match(_scored(spark, folder), CAMPAIGNS, WISHES, at_most=people_at_most(spark, folder))
    return typed(done, **MATCH_TYPES)


@query
def c3_blocking_pairs(spark, folder):
    """Pairs that would rather have each other: many after first offers and budgets, none after
    the match."""
    scored, _ = freeze(_scored(spark, folder))
    most = people_at_most(spark, folder)
    caps = {c.campaign_id: c.cap for c in CAMPAIGNS}
    lists = {
        "first_offers": campaigns.budget(campaigns.assign(scored, CAMPAIGNS), caps, at_most=most),
        "matched": matching.match(scored, CAMPAIGNS, at_most=most),
    }
    found = [
        matching.blocking_pairs(scored, table, CAMPAIGNS).select(F.lit(name).alias("list"), "campaign_id").union(
            # Every campaign is told of, pairs or not.
            spark.createDataFrame([(name, c.campaign_id) for c in CAMPAIGNS], "list string, campaign_id string")
        )
        for name, table in lists.items()
    ]
    counted = found[0].union(found[1]).groupBy("list", "campaign_id").agg((F.count(F.lit(1)) - 1).alias("pairs"))
    return typed(counted, list="string", campaign_id="string", pairs="bigint")


@query
def c4_top_k(spark, folder):
    done = campaigns.top_k(_assigned(spark, folder), 10)
    return typed(done, campaign_id="string", region="string", customer_id="bigint", place="bigint")


@query
def c5_budget(spark, folder):
    caps = {c.campaign_id: c.cap for c in CAMPAIGNS}
    done = campaigns.budget(_assigned(spark, folder), caps, at_most=people_at_most(spark, folder))
    return typed(done, campaign_id="string", customer_id="bigint", place="bigint", spent="double")


@query
def c6_holdout(spark, folder):
    done = campaigns.holdout(_assigned(spark, folder), 10)
    return typed(done, campaign_id="string", customer_id="bigint", arm="string")


LIST_TYPES = {
    "campaign_id": "string", "customer_id": "bigint", "region": "string", "segment": "string",
    "band": "string", "risk": "double", "value_at_risk": "double", "place": "bigint",
    "cost": "double", "spent": "double", "arm": "string", "reason": "string",
}


@query
def c7_campaign_list(spark, folder):
    return typed(churn.campaign_list(Inputs(spark, folder)), **LIST_TYPES)


@query
def c7_matched_list(spark, folder):
    return typed(churn.campaign_list(Inputs(spark, folder), matched=True), **LIST_TYPES)


@query
def c8_overlap(spark, folder):
    candidates, _ = freeze(_eligible(spark, folder).select("campaign_id", "customer_id"))
    valuable, lapsing = (candidates.where(F.col("campaign_id") == c) for c in ("rescue_value", "win_back"))
    return campaigns.overlap(valuable, lapsing)


@query
def c8_overlaps(spark, folder):
    """All lists at once."""
    return campaigns.overlaps(_eligible(spark, folder), [c.campaign_id for c in CAMPAIGNS])


@query
def c9_export(spark, folder):
    path = work_path(spark, "export")
    day = campaigns.export(churn.campaign_list(Inputs(spark, folder)), path, DAY)
    return typed(spark.read.parquet(day), **LIST_TYPES)


# Evaluation


def _rule_scores(spark, folder):
    return _scored(spark, folder).withColumn("probability", F.col("risk") / 100)


@query
def m6_auc(spark, folder):
    done = evaluation.auc(_rule_scores(spark, folder), at_most=people_at_most(spark, folder))
    return typed(done, positives="bigint", negatives="bigint", auc="double:9")


@query
def m6_auc_by_region(spark, folder):
    done = evaluation.auc(
        _rule_scores(spark, folder), by=["region"], at_most=people_at_most(spark, folder)
    )
    return typed(done, region="string", positives="bigint", negatives="bigint", auc="double:9")


@query
def m7_metrics(spark, folder):
    done = evaluation.metrics(_rule_scores(spark, folder), (0.25, 0.5, 0.75))
    return typed(
        done, threshold="double", **same(("tp", "fp", "tn", "fn"), "bigint"),
        **same(("precision", "recall", "f1"), "double"), log_loss="double:6", brier="double:6",
    )


@query
def m8_lift(spark, folder):
    done = evaluation.lift(_rule_scores(spark, folder), at_most=people_at_most(spark, folder))
    return typed(
        done, decile="bigint", customers="bigint", churners="bigint", churn_rate="double",
        lift="double:9", gain="double",
    )


@query
def m9_reliability(spark, folder):
    done = evaluation.reliability(_rule_scores(spark, folder))
    return typed(done, bin="bigint", customers="bigint", mean_score="double:6", observed="double:9")


@query
def m9_calibrate(spark, folder):
    rows, _ = freeze(_rule_scores(spark, folder))
    done = evaluation.calibrate(rows, evaluation.fit_calibration(rows))
    return typed(done, customer_id="bigint", probability="double", calibrated="double:9")


@query
def m9_crosswise(spark, folder):
    done = evaluation.calibrate_crosswise(_rule_scores(spark, folder))
    return typed(done, customer_id="bigint", probability="double", calibrated="double:9")


@query
def r1_risk_score(spark, folder):
    rows, _ = freeze(_rule_scores(spark, folder))
    done = evaluation.calibrate(rows, evaluation.fit_calibration(rows)).drop("risk")
    return risk.risk_score(done, "calibrated").select("customer_id", "risk")


# Models


def _training(spark, folder):
    table, _ = freeze(labels.split_by_key(churn.training_table(Inputs(spark, folder))))
    return table, table.where("split = 'train'"), table.where("split = 'test'")


SCORE_COLUMNS = ("customer_id", "churned", "probability", "margin", "predicted")


@query
def m1_assemble(spark, folder):
    rfm = features.rfm(S.purchases(spark, folder), DAY)
    cols = ("recency", "frequency", "monetary")
    slots = models.vector_to_array("features")
    return models.assemble(rfm, cols).select("customer_id", *[slots[i].alias(c) for i, c in enumerate(cols)])


@query
def m2_fit_logistic(spark, folder):
    _, train, test = _training(spark, folder)
    weighted = labels.class_weight(train)
    model = models.fit_logistic(weighted, churn.MODEL_COLUMNS, "weight")
    return models.score(model, test, churn.MODEL_COLUMNS).select(*SCORE_COLUMNS)


@query
def m3_fit_gbt(spark, folder):
    _, train, test = _training(spark, folder)
    model = models.fit_gbt(train, churn.MODEL_COLUMNS)
    return models.score(model, test, churn.MODEL_COLUMNS).select(*SCORE_COLUMNS)


@query
def m4_tune(spark, folder):
    _, train, _ = _training(spark, folder)
    return models.tune(train, churn.MODEL_COLUMNS, (0.0001, 0.001, 0.01, 0.1))[1]


@query
def m5_score(spark, folder):
    table, train, _ = _training(spark, folder)
    model = models.fit_logistic(train, churn.MODEL_COLUMNS)
    return models.score(model, table, churn.MODEL_COLUMNS).select(*SCORE_COLUMNS)


@query
def m10_importance(spark, folder):
    _, train, test = _training(spark, folder)
    model = models.fit_logistic(train, churn.MODEL_COLUMNS)
    return models.importance(model, test, churn.MODEL_COLUMNS)


def _contributions(spark, folder):
    df, train = _split(features.rfm(S.purchases(spark, folder), DAY))
    return explain.linear_contributions(df, LINEAR_WEIGHTS, features.moments(train, list(LINEAR_WEIGHTS)))


@query
def m11_linear_contributions(spark, folder):
    return typed(
        _contributions(spark, folder), customer_id="bigint", feature="string", contribution="double:6"
    )


@query
def m11_explain_linear(spark, folder):
    table, train, _ = _training(spark, folder)
    model = models.fit_logistic(train, churn.MODEL_COLUMNS)
    return explain.explain_linear(model, table, churn.MODEL_COLUMNS)


@query
def m12_explain_sampled(spark, folder):
    table, train, _ = _training(spark, folder)
    model = models.fit_logistic(train, churn.MODEL_COLUMNS)
    return explain.explain_sampled(
        model, table.where("split = 'test'"), churn.MODEL_COLUMNS, explain.background(train, churn.MODEL_COLUMNS, 8)
    )


@query
def m13_reasons(spark, folder):
    done = explain.reasons(_contributions(spark, folder), 2)
    return typed(
        done, customer_id="bigint", place="bigint", feature="string", contribution="double:6"
    )


@query
def m14_save_load(spark, folder):
    table, train, _ = _training(spark, folder)
    path = work_path(spark, "model")
    models.save_model(models.fit_logistic(train, churn.MODEL_COLUMNS), path)
    return models.score(models.load_model(path), table, churn.MODEL_COLUMNS).select(*SCORE_COLUMNS)


# Learners whose answers can be worked out: on one category a model's probability is the churn rate
# of the training rows of its cell.


def _cells(spark, folder):
    table, _ = freeze(labels.split_by_key(_scored(spark, folder)))
    return table, table.where("split = 'train'"), table.where("split = 'test'")


def _by_cell(train, cell, **options):
    return models.fit_logistic(train, (), categories=(cell,), reg=0.0, rounds=200, **options)


@query
def m2_cells(spark, folder):
    _, train, test = _cells(spark, folder)
    done = models.score(_by_cell(train, "region"), test, ())
    return typed(done, customer_id="bigint", region="string", probability="double:4")


@query
def m3_cells(spark, folder):
    _, train, test = _cells(spark, folder)
    model = models.fit_gbt(train, (), categories=("region",))
    return typed(models.score(model, test, ()), customer_id="bigint", region="string", predicted="bigint")


SEARCHED = {
    "market": lambda train: _by_cell(train, "market_segment"),
    "region": lambda train: _by_cell(train, "region"),
    "region_trees": lambda train: models.fit_gbt(train, (), categories=("region",), rounds=40, depth=5),
}


@query
def m4_search(spark, folder):
    """Two rungs over learners of both kinds; the winner goes by the measures."""
    _, train, _ = _cells(spark, folder)
    _, report = models.search(train, SEARCHED, work_path(spark, "search"), rungs=(60, 100))
    return typed(report, rung="bigint", candidate="string", fold="bigint", rows="bigint", auc="double:9", kept="bigint")


@query
def m5_cells(spark, folder):
    table, train, _ = _cells(spark, folder)
    done = models.score(_by_cell(train, "region"), table, ())
    return typed(done, customer_id="bigint", probability="double:4", margin="double:4", predicted="bigint")


@query
def m10_cells(spark, folder):
    _, train, test = _cells(spark, folder)
    done = models.importance(_by_cell(train, "region"), test, ("region",))
    return typed(done, feature="string", auc_drop="double:9")


@query
def m12_cells(spark, folder):
    """The model looks at the region alone, so all of its probability is the region's share."""
    table, train, test = _cells(spark, folder)
    cols = ("region", "market_segment")
    known = explain.background(train, cols, 32)
    done = explain.explain_sampled(_by_cell(train, "region"), test, cols, known)
    # Adding zero makes a negative zero a plain one.
    return typed(done, customer_id="bigint", feature="string", contribution="double:4").withColumn(
        "contribution", F.col("contribution") + F.lit(0.0)
    )


@query
def m12_with_errors(spark, folder):
    """As before, in rounds of eight draws until the background is used up."""
    table, train, test = _cells(spark, folder)
    cols = ("region", "market_segment")
    done = explain.explain_with_errors(_by_cell(train, "region"), test, cols, explain.background(train, cols, 32), 0.0)
    return typed(done, customer_id="bigint", feature="string", contribution="double:4", error="double:4", draws="bigint").withColumn(
        "contribution", F.col("contribution") + F.lit(0.0)
    )


PREPARED = ("recency", "monetary", "mean_gap", "recency_to_gap")
PREPARED_TYPES = {
    "customer_id": "bigint",
    **{name: "double:6" for name in PREPARED}, **{f"{name}_missing": "bigint" for name in PREPARED},
    "market_segment_index": "bigint", "nation_index": "bigint",
}


@query
def m14_prepared(spark, folder):
    """Limits, fill values, scales and categories of the training rows, saved, loaded and applied."""
    gaps = features.gaps(S.purchases(spark, folder), DAY)
    table, _ = freeze(labels.split_by_key(_placed_rfm(spark, folder).join(gaps, "customer_id")))
    stages = prepare.input_stages(PREPARED, ("market_segment", "nation"), (0.01, 0.99))
    scaled = models.VectorAssembler(inputCols=[f"_p_{c}" for c in PREPARED], outputCol="_numbers")
    scale = models.StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True)
    rows = models.as_doubles(table, PREPARED)
    path = work_path(spark, "prepared")
    models.save_model(models.Pipeline(stages=[*stages, scaled, scale]).fit(rows.where("split = 'train'")), path)
    done = models.load_model(path).transform(rows)
    slots = models.vector_to_array("_scaled")
    return typed(
        done.select(
            "customer_id", *[slots[i].alias(c) for i, c in enumerate(PREPARED)],
            *[F.col(f"_p_{c}_missing").alias(f"{c}_missing") for c in PREPARED],
            F.col("_i_market_segment").alias("market_segment_index"), F.col("_i_nation").alias("nation_index"),
        ),
        **PREPARED_TYPES,
    ).withColumns({c: F.col(c) + F.lit(0.0) for c in PREPARED})  # no negative zeros


@query
def m14_cells(spark, folder):
    table, train, _ = _cells(spark, folder)
    path = work_path(spark, "model")
    models.save_model(_by_cell(train, "region", weight=None), path)
    done = models.score(models.load_model(path), table, ())
    return typed(done, customer_id="bigint", probability="double:4")


# Serving


PREDICTION_TYPES = {
    "customer_id": "bigint", "snapshot": "string", "segment": "string", "risk": "double",
    "band": "string",
}


def _predictions(spark, folder):
    past = churn.history(Inputs(spark, folder))
    return serving.predictions(past.select("snapshot", "customer_id", "segment", "risk", "band"))


@query
def p1_predictions(spark, folder):
    done = _predictions(spark, folder).withColumn("snapshot", iso("snapshot"))
    return typed(done, **PREDICTION_TYPES)


@query
def p2_lookup(spark, folder):
    # Every event asks for a customer id, some of which do not exist.
    asked = S.load(spark, folder, "events").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") * 11).alias("customer_id")
    )
    done = serving.lookup(_predictions(spark, folder), asked).withColumn("snapshot", iso("snapshot"))
    return typed(done, request_id="bigint", **PREDICTION_TYPES, found="bigint")


@query
def p1_store(spark, folder):
    """The same predictions, merged snapshot by snapshot into a bucketed table."""
    past, _ = freeze(churn.history(Inputs(spark, folder)).select("snapshot", "customer_id", "segment", "risk", "band"))
    path = work_path(spark, "store")
    for day in SNAPSHOTS:
        kept_rows = store.merge_snapshot(spark, path, past.where(F.col("snapshot") == F.lit(day).cast("timestamp_ntz")), 16)
    return typed(kept_rows.withColumn("snapshot", iso("snapshot")), **PREDICTION_TYPES)


@query
def p2_store_lookup(spark, folder):
    """A short list of ids, some unknown, asked for by value."""
    predicted, _ = freeze(_predictions(spark, folder))
    found = store.merge_snapshot(spark, work_path(spark, "store"), predicted, 16)
    asked = S.load(spark, folder, "events").where("event_id % 40 = 0").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") * 11).alias("customer_id")
    )
    done = store.ask(found, asked).withColumn("snapshot", iso("snapshot"))
    return typed(done, request_id="bigint", **PREDICTION_TYPES, found="bigint")


@query
def p3_score_stream(spark, folder):
    out = work_path(spark, "scored-events")
    scores, _ = freeze(_scored(spark, folder).select("customer_id", "risk", "band"))
    stream = streaming.event_stream(spark, f"{folder}/events.parquet")
    streaming.score_stream(stream, scores, f"{out}/data", f"{out}/state").awaitTermination()
    done = spark.read.parquet(f"{out}/data")
    return typed(
        done, event_id="bigint", customer_id="bigint", event_type="string", risk="double",
        band="string", known="bigint",
    )


@query
def p4_activity_stream(spark, folder):
    out = work_path(spark, "activity")
    stream = streaming.event_stream(spark, f"{folder}/events.parquet")
    streaming.write_activity(
        streaming.activity_stream(stream), f"{out}/data", f"{out}/state"
    ).awaitTermination()
    stored = S.load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done = streaming.whole_activity(spark.read.parquet(f"{out}/data"), stored)
    return typed(
        done.withColumn("day", iso("day_start")), day="string", customer_id="bigint", events="bigint",
        purchases="bigint", value="double", bad_values="bigint",
    )


@query
def p4_kept_activity(spark, folder):
    """Events in files by a hash, not by time, every fifth one sent twice and some without a time."""
    out = work_path(spark, "kept-activity")
    events = S.load(spark, folder, "events")
    events = events.withColumn("ts", F.when(F.col("event_id") % 97 != 0, F.col("ts")))
    again = events.where("event_id % 5 = 0").withColumn("_file", F.lit(1))
    sent = events.withColumn("_file", F.pmod(F.xxhash64("event_id"), F.lit(6)).cast("int")).union(again)
    sent.repartition(6, "_file").drop("_file").write.parquet(f"{out}/sent")
    stream = streaming.event_stream(spark, f"{out}/sent", files_per_batch=2)
    kept.keep_activity(stream, f"{out}/days", f"{out}/state").awaitTermination()
    done = kept.activity(spark, f"{out}/days").withColumn("day", iso("day"))
    return typed(
        done, day="string", customer_id="bigint", events="bigint", purchases="bigint", value="double", bad_values="bigint"
    )


# Shared


def _amounts(spark, folder):
    orders = S.load(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )


@query
def u1_global_rank(spark, folder):
    order = [F.col("amount").desc(), F.col("order_id")]
    done = ranking.global_rank(_amounts(spark, folder), order, sums=["amount"], single_task_rows=0)
    tile = ntile_of(F.col("rn"), F.col("rn_rows"), 7)
    return typed(
        done.withColumn("tile", tile), order_id="bigint", rn="bigint", tile="bigint", run_amount="double"
    )


@query
def u1_group_rank(spark, folder):
    order = [F.col("amount").desc(), F.col("order_id")]
    done = ranking.global_rank(
        _amounts(spark, folder), order, ["priority"], ["amount"], single_task_rows=0
    )
    return typed(
        done, order_id="bigint", priority="string", rn="bigint", rn_rows="bigint", run_amount="double"
    )
