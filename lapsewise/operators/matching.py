"""Customers and campaigns matched under budgets, so that nobody is cut without a second offer.

Deferred acceptance (Gale & Shapley 1962) with capacities in money. A customer prefers the offer
with the lowest ``wish``, then campaign name; a campaign prefers the highest ``worth``, then the
smallest customer id, and takes its candidates in that order as long as their summed cost is within
its cap. What a campaign refuses it also refuses from any larger set, so refusals are final, each
campaign's state is one cutoff, and the result is the stable match that is best for the customers,
whatever the order of the proposals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.functions import money
from lapsewise.operators.campaigns import Campaign
from lapsewise.operators.ranking import global_rank
from lapsewise.session import freeze

#: A cutoff that refuses everybody.
CLOSED = (None, None)


def offers(
    scored: DataFrame,
    campaigns: Sequence[Campaign],
    wishes: Mapping[str, str] | None = None,
    worths: Mapping[str, str] | None = None,
    worth: str = "value_at_risk",
) -> DataFrame:
    """Customers with at least one offer: ``scored`` plus ``offers``, an array sorted by the
    customer's own order. ``wishes`` and ``worths`` are expressions by campaign; by default a
    campaign's priority is every customer's wish and ``worth`` is what every campaign looks at.
    A NULL wish, worth or rule is no offer."""
    wishes, worths = wishes or {}, worths or {}
    every = []
    for c in campaigns:
        wish = F.expr(wishes[c.campaign_id]) if c.campaign_id in wishes else F.lit(c.priority)
        value = F.expr(worths.get(c.campaign_id, worth)).cast("double")
        offer = F.struct(
            wish.cast("double").alias("wish"), F.lit(c.campaign_id).alias("campaign_id"), F.lit(c.priority).alias("priority"),
            value.alias("worth"), F.lit(c.unit_cost).cast("decimal(18,2)").alias("cost"),
        )
        every.append(F.when(F.expr(c.rule) & wish.isNotNull() & value.isNotNull(), offer))
    found = scored.withColumn("offers", F.array_sort(F.array_compact(F.array(*every))))
    return found.where(F.size("offers") > 0)


def _open_to(offer: Column, cutoffs: Mapping[str, tuple]) -> Column:
    """Whether the campaign of an offer still takes this customer."""
    ok = F.lit(True)
    for campaign, (worth, customer) in cutoffs.items():
        within = (offer["worth"] > F.lit(worth)) | ((offer["worth"] == F.lit(worth)) & (F.col("customer_id") <= F.lit(customer)))
        ok = F.when(offer["campaign_id"] == campaign, F.lit(False) if worth is None else within).otherwise(ok)
    return ok


def _best(offered: DataFrame, cutoffs: Mapping[str, tuple]) -> DataFrame:
    """Every customer's first offer among the campaigns that are open to it; no shuffle."""
    left = F.get(F.filter("offers", lambda o: _open_to(o, cutoffs)), F.lit(0))
    return offered.withColumn("_best", left).where("_best is not null")


def _in_cents(amount: Decimal) -> int:
    return int(amount * 100)


def match(
    scored: DataFrame,
    campaigns: Sequence[Campaign],
    wishes: Mapping[str, str] | None = None,
    worths: Mapping[str, str] | None = None,
    worth: str = "value_at_risk",
    at_most: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """One stable campaign per customer: ``scored`` plus ``campaign_id, priority, cost, place,
    spent``, as ``campaigns.budget`` gives them. ``scored`` has one row per customer.

    A round is one pass over the customers with the cutoffs as literals, a sum per campaign and,
    for the campaigns that are asked for more than their cap, a ranking of those proposals. Only
    cutoffs come to the driver, one per campaign. Where all customers share the order of the
    campaigns, or all campaigns that of the customers, no more rounds than campaigns are needed.
    """
    kept = [c for c in scored.columns if c != "offers"]
    table, _ = freeze(offers(scored, campaigns, wishes, worths, worth))
    narrow = table.select("customer_id", "offers")
    caps = {c.campaign_id: _in_cents(c.cap) for c in campaigns}
    cutoffs: dict[str, tuple] = {}
    while True:
        asked = _best(narrow, cutoffs).select(
            "customer_id", "_best.campaign_id", "_best.worth", (F.col("_best.cost") * 100).cast("bigint").alias("cents")
        )
        demand = {r[0]: r[1] for r in asked.groupBy("campaign_id").agg(F.sum("cents")).collect()}
        over = [c for c, cents in demand.items() if cents > caps[c]]
        if not over:
            break
        order = [F.col("worth").desc(), F.col("customer_id")]
        ranked = global_rank(asked.where(F.col("campaign_id").isin(over)), order, ["campaign_id"], ["cents"], at_most, single_task_rows)
        cap = F.lit(None).cast("bigint")
        for c in over:
            cap = F.when(F.col("campaign_id") == c, F.lit(caps[c])).otherwise(cap)
        last = ranked.where(F.col("run_cents") <= cap).groupBy("campaign_id").agg(F.max_by(F.struct("worth", "customer_id"), "rn").alias("last"))
        found = {r.campaign_id: tuple(r["last"]) for r in last.collect()}
        cutoffs |= {c: found.get(c, CLOSED) for c in over}
    chosen = _best(table, cutoffs).select(
        *kept, "_best.campaign_id", "_best.priority", "_best.cost", F.col("_best.worth").alias("_worth"),
        (F.col("_best.cost") * 100).cast("bigint").alias("_cents"),
    )
    ranked = global_rank(chosen, [F.col("_worth").desc(), F.col("customer_id")], ["campaign_id"], ["_cents"], at_most, single_task_rows)
    return ranked.select(
        *kept, "campaign_id", "priority", "cost", F.col("rn").alias("place"), money("run__cents").alias("spent")
    )


def blocking_pairs(
    scored: DataFrame,
    matched: DataFrame,
    campaigns: Sequence[Campaign],
    wishes: Mapping[str, str] | None = None,
    worths: Mapping[str, str] | None = None,
    worth: str = "value_at_risk",
    single_task_rows: int | None = None,
) -> DataFrame:
    """``customer_id, campaign_id`` of every pair that would both rather have each other than what
    ``matched`` (``customer_id, campaign_id``) gives them: the customer wishes the campaign more, or
    has none, and the cost of those whom the campaign has and prefers leaves room for it."""
    offered = offers(scored, campaigns, wishes, worths, worth).select("customer_id", F.posexplode("offers").alias("_at", "_offer"))
    pairs = offered.select("customer_id", "_at", "_offer.campaign_id", "_offer.worth", (F.col("_offer.cost") * 100).cast("bigint").alias("cents"))
    has = matched.select(F.col("customer_id").alias("_id"), F.col("campaign_id").alias("_has"))
    joined = pairs.join(has, F.col("customer_id") == F.col("_id"), "left")
    mine = F.col("campaign_id").eqNullSafe(F.col("_has"))
    per_customer = joined.groupBy("customer_id").agg(F.min(F.when(mine, F.col("_at"))).alias("_place"))
    wanted, _ = freeze(
        joined.withColumn("_held", F.when(mine, F.col("cents")).otherwise(0)).withColumnRenamed("customer_id", "_c")
        .join(per_customer, F.col("_c") == F.col("customer_id"))
        .select("customer_id", "campaign_id", "worth", "cents", "_held", (F.coalesce(F.col("_at") < F.col("_place"), F.lit(True))).alias("_wished"))
    )
    # What the campaign holds among the candidates it prefers to this one.
    order = [F.col("worth").desc(), F.col("customer_id")]
    ranked = global_rank(wanted, order, ["campaign_id"], ["_held"], None, single_task_rows)
    cap = F.lit(None).cast("bigint")
    for c in campaigns:
        cap = F.when(F.col("campaign_id") == c.campaign_id, F.lit(_in_cents(c.cap))).otherwise(cap)
    room = F.col("run__held") - F.col("_held") + F.col("cents") <= cap
    return ranked.where(F.col("_wished") & (F.col("_held") == 0) & room).select("customer_id", "campaign_id")
