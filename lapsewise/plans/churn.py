"""Operators put together: who is likely to lapse, what it is worth and whom to contact."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise import sources
from lapsewise.functions import as_date
from lapsewise.operators import campaigns as C
from lapsewise.operators import explain, features, labels, matching, models, risk, segments
from lapsewise.operators.evaluation import auc, calibrate, fit_calibration, metrics
from lapsewise.operators.facts import facts
from lapsewise.operators.panel import panel
from lapsewise.operators.quality import handle_missing, key_check, validate
from lapsewise.operators.ranking import settle
from lapsewise.session import freeze

DAY = "2001-02-01"
HORIZON = 180
SNAPSHOTS = ("2000-05-01", "2000-08-01", "2000-11-01", "2001-02-01")

# Columns the models learn from.
MODEL_COLUMNS = (
    "recency", "frequency", "monetary", "mean_order", "tenure", "mean_gap", "sd_gap", "max_gap",
    "recency_to_gap", "orders_90", "spend_90", "orders_365", "spend_365", "spend_trend",
    "spend_slope", "lines", "quantity", "distinct_parts", "mean_discount", "mix_entropy",
)
# What a stored table's rows should hold: table -> key and predicates.
RULES = {
    "orders": ("o_orderkey", {"amount_not_negative": "o_totalprice >= 0", "dated": "o_orderdate is not null"}),
    "customer": ("c_custkey", {"nation_known": "c_nationkey is not null"}),
    "lineitem": ("l_orderkey", {"quantity_positive": "l_quantity > 0", "discount_is_a_share": "l_discount between 0 and 1"}),
}
MODEL_CATEGORIES = ("market_segment", "nation")
# Quantiles of the training rows to which the model's columns are clipped.
CLIP = (0.01, 0.99)

CAMPAIGNS = (
    C.Campaign("rescue_value", "value_at_risk >= 250000", 1, Decimal("12.50"), Decimal("250.00")),
    C.Campaign("win_back", "segment = 'at_risk' and band in ('medium', 'high', 'critical')", 2,
               Decimal("5.00"), Decimal("300.00")),
    C.Campaign("reactivate", "segment = 'hibernating'", 3, Decimal("1.20"), Decimal("150.00")),
    C.Campaign("welcome", "segment = 'new'", 4, Decimal("0.75"), Decimal("60.00")),
    C.Campaign("thank_you", "segment = 'champions' or risk < 10", 5, Decimal("2.00"), Decimal("200.00")),
)

#: Customers' own order of the campaigns, for a match; those not named keep their priority.
WISHES = {
    "rescue_value": "CASE WHEN recency > 150 THEN 1 ELSE 6 END",
    "win_back": "CASE WHEN frequency >= 8 THEN 0 ELSE 3 END",
    "reactivate": "recency % 5",
    "thank_you": "CASE WHEN region IN ('ASIA', 'EUROPE') THEN 0 ELSE 5 END",
}


@dataclass(frozen=True)
class Inputs:
    """The conformed tables of a folder, each opened when first used."""

    spark: SparkSession
    folder: str

    @cached_property
    def purchases(self) -> DataFrame:
        return sources.purchases(self.spark, self.folder)

    @cached_property
    def lines(self) -> DataFrame:
        return sources.lines(self.spark, self.folder)

    @cached_property
    def parts(self) -> DataFrame:
        return sources.parts(self.spark, self.folder)

    @cached_property
    def customers(self) -> DataFrame:
        return sources.customers(self.spark, self.folder)

    @cached_property
    def places(self) -> DataFrame:
        return sources.places(self.spark, self.folder)

    def with_purchases(self, purchases: DataFrame) -> Inputs:
        """The same tables with other purchases, e.g. cleaned ones."""
        other = Inputs(self.spark, self.folder)
        other.__dict__["purchases"] = purchases
        return other

    @cached_property
    def population(self) -> int:
        """No result with one row per known customer can be larger; read from file footers."""
        return self.customers.count()

    def people(self) -> DataFrame:
        """``customer_id, market_segment, nation, region``."""
        return self.customers.join(self.places, "nation_id", "left").select(
            "customer_id", "market_segment", "nation", "region"
        )


def scored_customers(
    inputs: Inputs, day: str | dt.date = DAY, horizon: int = HORIZON, single_task_rows: int | None = None
) -> DataFrame:
    """Population of the snapshot with RFM, label, segment, rule risk, band and value at risk.

    Customers without a record are left out by the join, after the orders have been reduced to
    one row per customer.
    """
    base = features.snapshot(inputs.purchases, day, horizon).join(inputs.people(), "customer_id")
    quintiled = segments.rfm5(base, (), inputs.population, single_task_rows)
    banded = risk.risk_band(risk.rule_risk(segments.rule_segment(quintiled)))
    return risk.value_at_risk(banded)


def feature_table(inputs: Inputs, day: str | dt.date = DAY) -> DataFrame:
    """One wide row per customer of the population; every block is keyed by the customer."""
    orders = features.order_features(inputs.purchases, day)
    lines = features.line_features(inputs.purchases, inputs.lines, inputs.parts, day)
    return orders.join(inputs.people(), "customer_id").join(lines, "customer_id", "left")


def training_table(inputs: Inputs, day: str | dt.date = DAY, horizon: int = HORIZON) -> DataFrame:
    label = labels.churn_label(inputs.purchases, day, horizon)
    return feature_table(inputs, day).join(label, "customer_id")


def history(
    inputs: Inputs,
    snaps: Sequence[str] = SNAPSHOTS,
    horizon: int = HORIZON,
    single_task_rows: int | None = None,
) -> DataFrame:
    """Segments and rule risk of every (snapshot, customer)."""
    known = panel(inputs.purchases, snaps, horizon).join(
        inputs.customers.select("customer_id"), "customer_id"
    )
    rows = inputs.population * len(snaps)
    quintiled = segments.rfm5(known, ["snapshot"], rows, single_task_rows)
    return risk.risk_band(risk.rule_risk(segments.rule_segment(quintiled)))


def campaign_list(
    inputs: Inputs,
    day: str | dt.date = DAY,
    campaigns: Sequence[C.Campaign] = CAMPAIGNS,
    quiet_days: int = 14,
    per_region: int | None = None,
    control_percent: int = 10,
    scored: DataFrame | None = None,
    single_task_rows: int | None = None,
    matched: bool = False,
) -> DataFrame:
    """Eligible, not suppressed, one campaign each, within budget, held out.

    ``per_region`` cuts a campaign to its best customers of every region first; by default the
    budget alone decides. With ``matched`` a customer whom one budget leaves out goes on to its
    next offer (``matching.match``), without it only the first offer counts. ``reason`` explains the rule risk; customers scored otherwise are passed
    as ``scored`` and get their reasons by ``with_reasons``.
    """
    ruled = scored is None
    if scored is None:
        scored = scored_customers(inputs, day, single_task_rows=single_task_rows)
    quiet = C.suppress(scored, C.recent_buyers(inputs.purchases, day, quiet_days))
    if matched and per_region is not None:
        raise ValueError("a match has no regional lists: leave out per_region")
    if matched:
        funded = matching.match(quiet, campaigns, at_most=inputs.population, single_task_rows=single_task_rows)
    else:
        short = C.assign(quiet, campaigns)
        if per_region is not None:
            short = C.top_k(short, per_region).drop("place")
        caps: Mapping[str, Decimal] = {c.campaign_id: c.cap for c in campaigns}
        # Ranges are drawn from a first run over the rows, so a scoring is not left in their plan.
        short, most = settle(short, inputs.population, single_task_rows)
        funded = C.budget(short, caps, "value_at_risk", most, single_task_rows)
    parts = {
        "recency": 50 * (5 - F.col("r5")) / 4,
        "frequency": 30 * (5 - F.col("f5")) / 4,
        "spend": 20 * (5 - F.col("m5")) / 4,
    }
    reason = C.reason_text(parts) if ruled else F.lit(None).cast("string")
    return C.holdout(funded, control_percent).select(
        "campaign_id", "customer_id", "region", "segment", "band", "risk", "value_at_risk", "place",
        "cost", "spent", "arm", reason.alias("reason"),
    )


def with_reasons(listed: DataFrame, contributions: DataFrame, k: int = 2) -> DataFrame:
    """``reason`` from contributions to the very score that put a customer on the list: the ``k``
    largest ones, e.g. ``recency:0.213;frequency:-0.107``."""
    told = (
        explain.reasons(contributions, k)
        .groupBy("customer_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "feature", "contribution"))).alias("_all"))
    )
    words = F.transform(
        "_all", lambda s: F.concat(s["feature"], F.lit(":"), s["contribution"].cast("decimal(18,3)").cast("string"))
    )
    told = told.select("customer_id", F.array_join(words, ";").alias("reason"))
    return listed.drop("reason").join(told, "customer_id", "left").select(*listed.columns)


def run_batch(
    spark: SparkSession,
    folder: str,
    out: str,
    day: str | dt.date = DAY,
    horizon: int = HORIZON,
    campaigns: Sequence[C.Campaign] = CAMPAIGNS,
    per_region: int | None = None,
    model_id: str = "gbt",
    permutations: int = 16,
    matched: bool = False,
    rules: Mapping[str, tuple[str, Mapping[str, str]]] = RULES,
) -> dict[str, str]:
    """From stored tables to exported campaign lists; returns the paths written.

    The model learns on the snapshot one horizon earlier, whose labels are known at ``day``.
    Facts, both feature tables and the predictions are written and read back, so that a later
    stage never repeats an earlier one. Orders without a customer record are set aside in
    ``quarantine``; the facts leave them out by their own join. Rows with values that do not fit
    their types are in ``rejected``, rows that break one of ``rules`` (by table: key and predicates)
    in ``violations``, repeated keys in ``key_faults``; none of these stops the run. A training snapshot whose label
    window runs past the data is refused, since its labels would be wrong. ``evaluation`` has
    the fitted model's measures on the test side, ``predictions`` are kept per snapshot and model,
    and the campaigns' reasons explain the model's own score.
    """
    raw = Inputs(spark, folder)
    names = (
        "rejected", "violations", "key_faults", "quarantine", "facts", "train", "current", "evaluation", "predictions",
        "model", "campaigns",
    )
    paths = {n: f"{out.rstrip('/')}/{n}" for n in names}
    earlier = as_date(day) - dt.timedelta(days=horizon)
    if labels.guard(raw.purchases, [earlier], horizon).where("censored = 1").count():
        raise ValueError(f"the orders end before {day}: labels of {earlier} are not known yet")

    def store(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        sources.save(df, paths[name], partition_by)
        return spark.read.parquet(paths[name])

    aside = [sources.set_aside(spark, folder, table) for table in sources.MAPPINGS]
    store(reduce(DataFrame.unionByName, aside), "rejected")
    checked = [validate(sources.load(spark, folder, t), t, key, broken) for t, (key, broken) in rules.items()]
    store(reduce(DataFrame.unionByName, checked), "violations")
    keyed = {"orders": (raw.purchases, "order_id"), "customer": (raw.customers, "customer_id")}
    repeated = [
        key_check(df, [key]).select(F.lit(t).alias("table"), F.col(key).cast("string").alias("key"), "rows") for t, (df, key) in keyed.items()
    ]
    store(reduce(DataFrame.unionByName, repeated), "key_faults")
    store(handle_missing(raw.purchases, raw.customers, "quarantine"), "quarantine")
    full = facts(raw.purchases, raw.lines, raw.customers, raw.places)
    stored = store(full.withColumn("order_year", F.year("order_ts")), "facts", ("order_year",))
    inputs = raw.with_purchases(stored.select("order_id", "customer_id", "order_ts", "cents"))
    train = store(labels.split_by_key(training_table(inputs, earlier, horizon)), "train")
    current = store(feature_table(inputs, day), "current")

    model = models.fit_gbt(train.where("split = 'train'"), MODEL_COLUMNS, categories=MODEL_CATEGORIES, clip=CLIP)
    models.save_model(model, paths["model"])
    tested, _ = freeze(models.score(model, train.where("split = 'test'"), MODEL_COLUMNS))
    measures = metrics(tested, (0.25, 0.5, 0.75)).withColumn("auc", auc(tested).select("auc").scalar())
    store(measures.withColumn("model_id", F.lit(model_id)), "evaluation")
    curve = fit_calibration(tested)
    raw_scores = models.score(model, current, MODEL_COLUMNS)
    scored = risk.risk_score(calibrate(raw_scores, curve), "calibrated")
    scored = risk.value_at_risk(risk.risk_band(segments.rule_segment(segments.rfm5(scored))))
    scored = scored.withColumn("snapshot", F.lit(as_date(day))).withColumn("model_id", F.lit(model_id))
    predicted = store(scored, "predictions", ("snapshot", "model_id")).where(
        (F.col("snapshot") == F.lit(as_date(day))) & (F.col("model_id") == model_id)
    )
    listed, _ = freeze(campaign_list(inputs, day, campaigns, per_region=per_region, scored=predicted, matched=matched))
    chosen = current.join(listed.select("customer_id"), "customer_id", "left_semi")
    inputs_of_model = (*MODEL_COLUMNS, *MODEL_CATEGORIES)
    known = explain.background(train.where("split = 'train'"), inputs_of_model, permutations)
    told = explain.explain_sampled(model, chosen, inputs_of_model, known)
    C.export(with_reasons(listed, told), paths["campaigns"], day)
    return paths
