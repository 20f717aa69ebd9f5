"""Campaign lists: who is contacted, for what, and who is held out."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapsewise.functions import as_date, at, money, percent_bucket
from lapsewise.operators.ranking import global_rank
from lapsewise.sources import save


@dataclass(frozen=True)
class Campaign:
    """``rule`` is a predicate over the scored customers; the lowest ``priority`` goes first."""

    campaign_id: str
    rule: str
    priority: int
    unit_cost: Decimal
    cap: Decimal


def _offers(campaigns: Sequence[Campaign]) -> Column:
    """The campaigns whose rule holds, ordered by priority and name when compared."""
    offers = [
        F.when(
            F.expr(c.rule),
            F.struct(
                F.lit(c.priority).alias("priority"),
                F.lit(c.campaign_id).alias("campaign_id"),
                F.lit(c.unit_cost).cast("decimal(18,2)").alias("cost"),
            ),
        )
        for c in campaigns
    ]
    return F.array_compact(F.array(*offers))


def eligible(scored: DataFrame, campaigns: Sequence[Campaign]) -> DataFrame:
    """One row per (customer, campaign whose rule holds), in one pass over the customers."""
    return scored.select("*", F.explode(_offers(campaigns)).alias("_offer")).select(
        *scored.columns, "_offer.campaign_id", "_offer.priority", "_offer.cost"
    )


def suppress(candidates: DataFrame, excluded: DataFrame, day: str | dt.date | None = None) -> DataFrame:
    """Drop candidates listed in ``excluded`` (customer ids, repeats allowed).

    With ``day`` an exclusion counts only while it holds: from its ``since`` through its ``until``,
    both days included, NULL without a bound.
    """
    if day is not None:
        on = F.lit(as_date(day))
        begun, ended = F.coalesce(F.to_date("since") <= on, F.lit(True)), F.coalesce(F.to_date("until") < on, F.lit(False))
        excluded = excluded.where(begun & ~ended)
    return candidates.join(excluded.select("customer_id").distinct(), "customer_id", "left_anti")


def suppress_dated(candidates: DataFrame, excluded: DataFrame, day: str = "day") -> DataFrame:
    """``suppress`` for candidates of many days: each row's own column ``day`` decides."""
    spans = excluded.select(
        F.col("customer_id").alias("_who"), F.to_date("since").alias("_since"), F.to_date("until").alias("_until")
    ).distinct()
    holds = (
        (F.col("customer_id") == F.col("_who"))
        & F.coalesce(F.col("_since") <= F.to_date(day), F.lit(True)) & F.coalesce(F.col("_until") >= F.to_date(day), F.lit(True))
    )
    return candidates.join(spans, holds, "left_anti")


def recent_buyers(purchases: DataFrame, day, days: int) -> DataFrame:
    """Customers with an order in the ``days`` days before ``day``, as exclusions."""
    recent = purchases.where((F.col("order_ts") >= at(day, -days)) & (F.col("order_ts") < at(day)))
    return recent.select("customer_id").distinct().withColumn("reason", F.lit("recent_purchase"))


def assign(scored: DataFrame, campaigns: Sequence[Campaign]) -> DataFrame:
    """The best offer of every customer with one: lowest priority, then campaign name.

    All offers of a customer arise in the customer's own row, so the best is taken there, without
    a shuffle. ``scored`` has one row per customer; suppress customers before.
    """
    best = F.array_min(_offers(campaigns))
    return scored.withColumn("_best", best).where("_best is not null").select(
        *scored.columns, F.col("_best.campaign_id").alias("campaign_id"),
        F.col("_best.priority").alias("priority"), F.col("_best.cost").alias("cost"),
    )


def top_k(
    candidates: DataFrame,
    k: int,
    by: Sequence[str] = ("campaign_id", "region"),
    value: str = "value_at_risk",
    at_most: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """The ``k`` highest values per group, with ``place``.

    While Spark limits a window to k rows per group in each task before the shuffle, which it does
    below ``spark.sql.optimizer.windowGroupLimitThreshold``, that is the plan. A longer list goes
    through the global ranking, so that no task has to sort a whole group.
    """
    order = [F.col(value).desc(), F.col("customer_id")]
    if k >= int(candidates.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        ranked = global_rank(candidates, order, by, (), at_most, single_task_rows)
        return ranked.where(F.col("rn") <= k).select(*candidates.columns, F.col("rn").alias("place"))
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint")
    return candidates.withColumn("place", place).where(F.col("place") <= k)


def budget(
    candidates: DataFrame,
    caps: Mapping[str, Decimal],
    value: str = "value_at_risk",
    at_most: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """Highest value first, as long as the summed ``cost`` of a campaign is within its cap.

    Adds ``place`` and ``spent``. A campaign can hold most customers, so the running sum is
    global over ranges, not one task per campaign.
    """
    order = [F.col(value).desc(), F.col("customer_id")]
    costed = candidates.withColumn("_cents", (F.col("cost") * 100).cast("bigint"))
    ranked = global_rank(costed, order, ["campaign_id"], ["_cents"], at_most, single_task_rows)
    cap = F.lit(None).cast("bigint")
    for campaign, amount in caps.items():
        cap = F.when(F.col("campaign_id") == campaign, F.lit(int(amount * 100))).otherwise(cap)
    return ranked.where(F.col("run__cents") <= cap).select(
        *candidates.columns, F.col("rn").alias("place"), money("run__cents").alias("spent")
    )


def holdout(candidates: DataFrame, percent: int, salt: str = "holdout") -> DataFrame:
    """Add ``arm``: a fixed ``percent`` of the customers is 'control', the rest 'contact'."""
    held = percent_bucket("customer_id", salt) < percent
    return candidates.withColumn("arm", F.when(held, "control").otherwise("contact"))


def reason_text(parts: Mapping[str, Column], k: int = 2) -> Column:
    """The ``k`` largest positive parts as text, e.g. ``recency:37.50;frequency:15.00``."""
    items = F.array(
        *[F.struct((-v.cast("double")).alias("v"), F.lit(name).alias("name")) for name, v in parts.items()]
    )
    ordered = F.slice(F.array_sort(F.filter(items, lambda s: s["v"] < 0)), 1, k)
    words = F.transform(
        ordered, lambda s: F.concat(s["name"], F.lit(":"), (-s["v"]).cast("decimal(18,2)").cast("string"))
    )
    return F.array_join(words, ";")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each customer on either list once, with ``side`` both / only_a / only_b."""
    rows = a.select("customer_id", F.lit("a").alias("_on")).union(
        b.select("customer_id", F.lit("b").alias("_on"))
    )
    side = F.when(F.min("_on") < F.max("_on"), "both").otherwise(F.concat(F.lit("only_"), F.min("_on")))
    return rows.groupBy("customer_id").agg(side.alias("side"))


#: Lists that one number has bits for.
MOST_LISTS = 63


def overlaps(listed: DataFrame, lists: Sequence[str]) -> DataFrame:
    """``a, b, both, only_a, only_b`` for every two of ``lists`` (names, ``a`` the smaller), from rows
    (``campaign_id, customer_id``); repeats count once, other campaigns and NULL ids not at all.

    A customer becomes one bitmap of the lists it is on, customers are counted per bitmap, and all
    pairs are read off the bitmaps: one shuffle of the rows, whatever the number of lists.
    """
    names = sorted(set(lists))
    if len(names) > MOST_LISTS:
        raise ValueError(f"{len(names)} lists; a bitmap has room for {MOST_LISTS}")
    bit = F.lit(None).cast("bigint")
    for k, name in enumerate(names):
        bit = F.when(F.col("campaign_id") == name, F.lit(1 << k)).otherwise(bit)
    maps = (
        listed.select("customer_id", bit.alias("_bit")).where("customer_id is not null and _bit is not null")
        .groupBy("customer_id").agg(F.bit_or("_bit").alias("_map"))
        .groupBy("_map").agg(F.count(F.lit(1)).alias("_n"))
    )
    pairs = [{"a": a, "b": b, "x": 1 << x, "y": 1 << y} for x, a in enumerate(names) for y, b in enumerate(names) if x < y]
    table = F.from_json(F.lit(json.dumps(pairs)), "array<struct<a string, b string, x bigint, y bigint>>")
    # A bitmap of no list, so that every pair is told of.
    nobody = maps.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("_map"), F.lit(0).cast("bigint").alias("_n"))
    each = maps.union(nobody).select("_map", "_n", F.inline(table))
    on_a, on_b = ((F.col("_map").bitwiseAND(F.col(c)) != 0) for c in ("x", "y"))

    def count(those: Column) -> Column:
        return F.sum(F.when(those, F.col("_n")).otherwise(0))

    return each.groupBy("a", "b").agg(
        count(on_a & on_b).alias("both"), count(on_a & ~on_b).alias("only_a"), count(on_b & ~on_a).alias("only_b")
    )


def export(campaign_list: DataFrame, path: str, day: str | dt.date, fmt: str = "parquet") -> str:
    """One folder per day, and in it one per campaign; returns the day's folder.

    A day's folder is replaced as a whole: a campaign without candidates leaves nothing behind.
    """
    folder = f"{path.rstrip('/')}/day={as_date(day)}"
    save(campaign_list, folder, ("campaign_id",), fmt, whole=True)
    return folder
