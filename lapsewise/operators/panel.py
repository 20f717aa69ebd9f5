"""Features of many snapshots at once.

Joining every order to every later snapshot multiplies the orders by the number of snapshots.
Here an order is turned into a few changes instead - it enters every sum at the first snapshot
after it and leaves a trailing sum at the first snapshot beyond the window - the changes are
added up per (customer, snapshot), and running sums over the snapshots give the state at each.
The work is linear in the orders and the result.
"""

from __future__ import annotations

import datetime as dt
import json
from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapsewise.functions import as_date, money, ratio
from lapsewise.operators.facts import as_of, by_day
from lapsewise.operators.features import (
    PART_TYPES,
    _with_gap,
    gap_moments,
    slope,
)


def _first_after(day: Column, snaps: Sequence[dt.date]) -> Column:
    """Index of the first snapshot later than ``day``; NULL when there is none. ``snaps`` ascend.

    Every day from the first snapshot to the last has its answer in one constant array, so a row
    costs one look whatever the number of snapshots.
    """
    first, last = snaps[0], snaps[-1]
    answers = [bisect_right(snaps, first + dt.timedelta(days=n)) for n in range((last - first).days)]
    table = F.from_json(F.lit(json.dumps(answers)), "array<int>")
    return F.when(day < F.lit(first), 0).when(day < F.lit(last), F.get(table, F.datediff(day, F.lit(first))))


def _by_slot() -> WindowSpec:
    return W.partitionBy("customer_id").orderBy("slot")


def _so_far() -> WindowSpec:
    return _by_slot().rowsBetween(W.unboundedPreceding, W.currentRow)


def _states(per_slot: DataFrame, totals: Sequence[Column], dates: Sequence[dt.date]) -> DataFrame:
    """Running ``totals`` at every snapshot from a customer's first change on; a state holds
    until the next change."""
    until = F.lead("slot", 1, len(dates)).over(_by_slot())
    reached = per_slot.select("customer_id", "slot", until.alias("until"), *totals)
    days = F.array(*[F.lit(d) for d in dates])
    held = F.slice(days, F.col("slot") + 1, F.col("until") - F.col("slot"))
    rest = [c for c in reached.columns if c not in ("slot", "until")]
    return reached.select(F.explode(held).alias("snapshot"), *rest)


def panel(
    purchases: DataFrame,
    snaps: Sequence[str | dt.date],
    horizon: int,
    windows: Sequence[int] = (180, 365),
    span: int = 180,
) -> DataFrame:
    """Purchase features and churn label per (snapshot, customer).

    A customer is in a snapshot when an order precedes it. ``churned`` is 1 when no order falls
    in the ``horizon`` days from the snapshot on.
    """
    dates = sorted(as_date(s) for s in snaps)
    shown, windows = windows, sorted({*windows, span, 2 * span})
    end = dates[-1] + dt.timedelta(days=horizon)
    days = _with_gap(by_day(as_of(purchases, end)))
    day = F.col("day")

    def change(slot: Column, **values: Column) -> Column:
        fields = {
            "orders": F.lit(0).cast("bigint"),
            "spend": F.lit(0).cast("bigint"),
            "gap": F.lit(0).cast("bigint"),
            "gap_sq": F.lit(0).cast("bigint"),
            "sx": F.lit(0).cast("bigint"),
            "sxx": F.lit(0).cast("bigint"),
            "sxy": F.lit(0.0),
            "gap_max": F.lit(None).cast("int"),
            "first": F.lit(None).cast("date"),
            "last": F.lit(None).cast("date"),
            "ahead": F.lit(0).cast("bigint"),
            **{f"orders_{n}": F.lit(0).cast("bigint") for n in windows},
            **{f"spend_{n}": F.lit(0).cast("bigint") for n in windows},
        }
        fields.update(values)
        return F.struct(slot.alias("slot"), *[v.alias(k) for k, v in fields.items()])

    # An order is in the label window of snapshot s while s <= day < s + horizon, and in the
    # trailing n days while day < s <= day + n. A window that is entered and left between two
    # snapshots is never seen and makes no change.
    enters = F.col("enters")
    days = days.select(
        "*",
        _first_after(day, dates).alias("enters"),
        _first_after(F.date_sub(day, horizon), dates).alias("awaits"),
        *[_first_after(F.date_add(day, n), dates).alias(f"leaves_{n}") for n in windows],
    ).select(
        "*",
        (~F.col("awaits").eqNullSafe(enters)).alias("awaited"),
        *[(~F.col(f"leaves_{n}").eqNullSafe(enters)).alias(f"held_{n}") for n in windows],
    )
    gap = F.coalesce(F.col("gap"), F.lit(0)).cast("bigint")
    spend = F.col("spend")
    # The slope does not depend on where time starts.
    x = F.datediff(day, F.lit(dates[0])).cast("bigint")
    changes = [
        change(
            enters,
            orders=F.col("orders"),
            spend=spend,
            gap=gap,
            gap_sq=gap * gap,
            sx=x * F.col("orders"),
            sxx=x * x * F.col("orders"),
            sxy=(x * spend).cast("double"),
            gap_max=F.when(F.col("orders") > 1, F.greatest(gap, F.lit(0))).otherwise(F.col("gap")).cast("int"),
            first=day,
            last=day,
            ahead=F.when(F.col("awaited"), F.lit(-1)).otherwise(F.lit(0)).cast("bigint"),
            **{f"orders_{n}": F.when(F.col(f"held_{n}"), F.col("orders")).otherwise(0) for n in windows},
            **{f"spend_{n}": F.when(F.col(f"held_{n}"), spend).otherwise(0) for n in windows},
        ),
        change(F.when(F.col("awaited"), F.col("awaits")), ahead=F.lit(1).cast("bigint")),
    ]
    for n in windows:
        changes.append(
            change(
                F.when(F.col(f"held_{n}"), F.col(f"leaves_{n}")),
                **{f"orders_{n}": -F.col("orders"), f"spend_{n}": -spend},
            )
        )
    added = ["orders", "spend", "gap", "gap_sq", "sx", "sxx", "sxy", "ahead"]
    added += [f"{kind}_{n}" for n in windows for kind in ("orders", "spend")]
    per_slot = (
        days.select("customer_id", F.inline(F.array(*changes)))
        .where("slot is not null")
        .groupBy("customer_id", "slot")
        .agg(
            *[F.sum(c).alias(c) for c in added],
            F.max("gap_max").alias("gap_max"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
    )
    totals = [F.sum(c).over(_so_far()).alias(c) for c in added]
    totals += [
        F.max("gap_max").over(_so_far()).alias("gap_max"),
        F.min("first").over(_so_far()).alias("first"),
        F.max("last").over(_so_far()).alias("last"),
    ]
    state = _states(per_slot, totals, dates).where("orders > 0")
    snap = F.col("snapshot")
    pairs = F.col("orders") - 1
    mean_gap, sd_gap = gap_moments(pairs, F.col("gap").cast("double"), F.col("gap_sq").cast("double"))
    recency = F.datediff(snap, "last")
    prior = (F.col(f"spend_{2 * span}") - F.col(f"spend_{span}")) / 100.0
    n, sx, sxx = (F.col(c).cast("double") for c in ("orders", "sx", "sxx"))
    return state.select(
        "snapshot",
        "customer_id",
        recency.alias("recency"),
        F.col("orders").alias("frequency"),
        money("spend").alias("monetary"),
        ratio(F.col("spend") / 100.0, F.col("orders")).alias("mean_order"),
        F.datediff(snap, "first").alias("tenure"),
        mean_gap.alias("mean_gap"),
        sd_gap.alias("sd_gap"),
        F.col("gap_max").alias("max_gap"),
        F.try_divide(recency.cast("double"), mean_gap).alias("recency_to_gap"),
        *[F.col(f"orders_{w}") for w in shown],
        *[money(f"spend_{w}").alias(f"spend_{w}") for w in shown],
        ratio(F.col(f"spend_{span}") / 100.0, prior).alias("spend_trend"),
        slope(n, sx, sxx, F.col("spend").cast("double"), F.col("sxy")).alias("spend_slope"),
        (F.col("ahead") <= 0).cast("int").alias("churned"),
    )


def line_panel(
    purchases: DataFrame,
    lines: DataFrame,
    parts: DataFrame,
    snaps: Sequence[str | dt.date],
    types: Sequence[str] = PART_TYPES,
) -> DataFrame:
    """Basket and mix per (snapshot, customer) with lines before the snapshot.

    Lines are added up per (customer, part, first snapshot after them) before they meet the
    parts; a part counts as distinct where the customer buys it first.
    """
    dates = sorted(as_date(s) for s in snaps)
    slot = _first_after(F.to_date("order_ts"), dates).alias("slot")
    cut = as_of(purchases, dates[-1]).select("order_id", "customer_id", slot)
    per_part = (
        lines.join(cut, "order_id")
        .groupBy("customer_id", "part_id", "slot")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum("quantity_hundredths").alias("quantity"),
            F.sum("discount_bp").alias("discount"),
        )
    )
    # At most one row per snapshot in a window.
    first = F.min("slot").over(W.partitionBy("customer_id", "part_id"))
    placed = per_part.withColumn("is_new", (F.col("slot") == first).cast("bigint"))
    added = ["lines", "quantity", "discount", "is_new"]
    # Quantities per type only grow, so all that a state needs is a running sum or maximum of what
    # changes at its snapshot: of q ln q for the entropy, of the new q for the favourite.
    by_type = placed.join(parts, "part_id", "left").groupBy("customer_id", "part_type", "slot").agg(*[F.sum(c).alias(c) for c in added])
    of_type = W.partitionBy("customer_id", "part_type").orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    quantity = F.coalesce("quantity", F.lit(0))
    after = F.sum(quantity).over(of_type)
    grown = by_type.select("*", quantity.alias("_q"), after.alias("_after"), (after - quantity).alias("_before"))

    def weighted(q: str) -> Column:
        return F.when(F.col(q) > 0, F.col(q) * F.ln(q)).otherwise(0.0)

    listed = {f"_t{k}": F.when(F.col("part_type") == t, F.col("_q")).otherwise(0) for k, t in enumerate(types)}
    place = F.struct((-F.col("_after")).alias("q"), F.col("part_type").isNull().alias("n"), F.col("part_type").alias("t"))
    per_slot = grown.groupBy("customer_id", "slot").agg(
        *[F.sum(c).alias(c) for c in added], F.sum("_q").alias("_q"), F.sum(weighted("_after") - weighted("_before")).alias("_w"),
        *[F.sum(value).alias(name) for name, value in listed.items()], F.min(place).alias("_best"),
    )
    summed = [*added, "_q", "_w", *listed]
    state = _states(
        per_slot, [*[F.sum(c).over(_so_far()).alias(c) for c in summed], F.min("_best").over(_so_far()).alias("_best")], dates
    )
    total = F.col("_q")
    other = total - sum((F.col(c) for c in listed), F.lit(0))
    return state.select(
        "snapshot",
        "customer_id",
        "lines",
        money("quantity").alias("quantity"),
        F.col("is_new").alias("distinct_parts"),
        ratio(F.col("discount") / 10000.0, F.col("lines")).alias("mean_discount"),
        *[ratio(F.col(c), total).alias(f"share_{t.lower()}") for c, t in zip(listed, types)],
        ratio(other, total).alias("share_other"),
        # Sums of rounded terms may end a little below nothing.
        F.when(total > 0, F.greatest(F.ln(total) - F.col("_w") / total, F.lit(0.0))).otherwise(0.0).alias("mix_entropy"),
        F.when(total > 0, F.col("_best.t")).alias("favourite_type"),
    )
