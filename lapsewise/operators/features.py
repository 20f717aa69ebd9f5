"""Customer features known at a snapshot day.

The order-based blocks share expressions over rows of (customer, day, orders, spend). A single
block runs them on the orders themselves; the feature table runs all of them in one
aggregation over calendar days, which bounds the rows any one customer can bring together.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapsewise.functions import as_date, at, money, ratio
from lapsewise.operators.facts import as_of, by_day
from lapsewise.operators.ranking import percent_ranks, quantiles
from lapsewise.session import freeze

WINDOWS = (30, 90, 180, 365)
# The part types with a share of their own.
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _single(purchases: DataFrame) -> DataFrame:
    return purchases.select(
        "customer_id",
        F.to_date("order_ts").alias("day"),
        F.lit(1).cast("bigint").alias("orders"),
        F.col("cents").alias("spend"),
    )


def _age(day: dt.date) -> Column:
    """Days before the snapshot, 1 for the last day that counts."""
    return F.datediff(F.lit(day), F.col("day"))


def _rfm(day: dt.date) -> list[Column]:
    return [
        F.min(_age(day)).alias("recency"),
        F.sum("orders").alias("frequency"),
        money(F.sum("spend")).alias("monetary"),
        ratio(F.sum("spend") / 100.0, F.sum("orders")).alias("mean_order"),
        F.max(_age(day)).alias("tenure"),
    ]


def _trailing(day: dt.date, windows: Sequence[int]) -> list[Column]:
    out = []
    for n in windows:
        inside = _age(day) <= n
        out.append(F.coalesce(F.sum(F.when(inside, F.col("orders"))), F.lit(0)).alias(f"orders_{n}"))
        out.append(
            money(F.coalesce(F.sum(F.when(inside, F.col("spend"))), F.lit(0))).alias(f"spend_{n}")
        )
    return out


def _trend(day: dt.date, span: int) -> list[Column]:
    age = _age(day)
    last = F.sum(F.when(age <= span, F.col("spend")).otherwise(F.lit(0)))
    prior = F.sum(F.when((age > span) & (age <= 2 * span), F.col("spend")).otherwise(F.lit(0)))
    # Least squares of spend per order on time, from sums that combine map-side. Only the
    # product sum is a double: it could exceed 64 bits for a very large customer.
    x = -age.cast("bigint")
    n = F.sum("orders").cast("double")
    sx = F.sum(x * F.col("orders")).cast("double")
    sxx = F.sum(x * x * F.col("orders")).cast("double")
    sy = F.sum("spend").cast("double")
    sxy = F.sum((x * F.col("spend")).cast("double"))
    return [
        ratio(last / 100.0, prior / 100.0).alias("spend_trend"),
        slope(n, sx, sxx, sy, sxy).alias("spend_slope"),
    ]


def slope(n: Column, sx: Column, sxx: Column, sy: Column, sxy: Column) -> Column:
    """Least-squares slope from sums over days x and cents y, in money per day; NULL when all x
    are equal. The sums are whole numbers, so that the differences do not lose digits."""
    return F.try_divide(n * sxy - sx * sy, 100.0 * (n * sxx - sx * sx))


def gap_moments(pairs: Column, total: Column, squares: Column) -> tuple[Column, Column]:
    """Mean and sample deviation of ``pairs`` gaps from their sum and sum of squares."""
    some = F.nullif(pairs, F.lit(0)).cast("double")
    spread = F.try_divide(squares - total * total / some, (pairs - 1).cast("double"))
    return F.try_divide(total, some), F.when(pairs > 1, F.sqrt(F.greatest(spread, F.lit(0.0))))


def _gaps(day: dt.date) -> list[Column]:
    """Over day rows carrying ``gap``; further orders on one day are gaps of zero days."""
    pairs = F.sum("orders") - 1
    gap = F.coalesce("gap", F.lit(0)).cast("bigint")
    total = F.sum(gap).cast("double")
    squares = F.sum(gap * gap).cast("double")
    mean, spread = gap_moments(pairs, total, squares)
    return [
        mean.alias("mean_gap"),
        spread.alias("sd_gap"),
        F.when(pairs > 0, F.coalesce(F.max("gap"), F.lit(0))).alias("max_gap"),
        F.try_divide(F.min(_age(day)).cast("double"), mean).alias("recency_to_gap"),
    ]


def _with_gap(days: DataFrame) -> DataFrame:
    previous = F.lag("day").over(W.partitionBy("customer_id").orderBy("day"))
    return days.withColumn("gap", F.datediff("day", previous))


def rfm(purchases: DataFrame, day: str | dt.date) -> DataFrame:
    """Recency in days, order count, spend, mean order and tenure."""
    cut = _single(as_of(purchases, day))
    return cut.groupBy("customer_id").agg(*_rfm(as_date(day)))


def gaps(purchases: DataFrame, day: str | dt.date) -> DataFrame:
    """Mean, deviation and maximum of the days between orders; NULL for a single order."""
    days = _with_gap(by_day(as_of(purchases, day)))
    return days.groupBy("customer_id").agg(*_gaps(as_date(day)))


def trailing(purchases: DataFrame, day: str | dt.date, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Order count and spend of the last n days, for each n."""
    cut = _single(as_of(purchases, day))
    return cut.groupBy("customer_id").agg(*_trailing(as_date(day), windows))


def trend(purchases: DataFrame, day: str | dt.date, span: int = 180) -> DataFrame:
    """Spend of the last ``span`` days over the span before, and the slope of spend on time."""
    cut = _single(as_of(purchases, day))
    return cut.groupBy("customer_id").agg(*_trend(as_date(day), span))


def order_features(purchases: DataFrame, day: str | dt.date) -> DataFrame:
    """All order-based blocks in one pass."""
    at_day = as_date(day)
    days = _with_gap(by_day(as_of(purchases, day)))
    return days.groupBy("customer_id").agg(
        *_rfm(at_day), *_gaps(at_day), *_trailing(at_day, WINDOWS), *_trend(at_day, 180)
    )


def snapshot(
    purchases: DataFrame, day: str | dt.date, horizon: int, windows: Sequence[int] = (365,)
) -> DataFrame:
    """RFM, trailing sums and churn label of one snapshot in a single aggregation.

    Orders of the label window take part with empty feature columns, so the orders are read and
    shuffled once.
    """
    at_day = as_date(day)
    before = F.col("order_ts") < at(day)
    rows = purchases.where(F.col("order_ts") < at(day, horizon)).select(
        "customer_id",
        before.alias("before"),
        F.when(before, F.to_date("order_ts")).alias("day"),
        F.when(before, F.lit(1).cast("bigint")).alias("orders"),
        F.when(before, F.col("cents")).alias("spend"),
    )
    return (
        rows.groupBy("customer_id")
        .agg(
            *_rfm(at_day),
            *_trailing(at_day, windows),
            F.bool_and("before").cast("int").alias("churned"),
        )
        .where("frequency > 0")
    )


def _customer_lines(purchases: DataFrame, lines: DataFrame, day: str | dt.date) -> DataFrame:
    cut = as_of(purchases, day).select("order_id", "customer_id")
    return lines.join(cut, "order_id")


def _basket(parts: Column) -> list[Column]:
    return [
        F.sum("lines").alias("lines"),
        money(F.sum("quantity")).alias("quantity"),
        parts.alias("distinct_parts"),
        ratio(F.sum("discount") / 10000.0, F.sum("lines")).alias("mean_discount"),
    ]


def _per_part(lines: DataFrame) -> DataFrame:
    return lines.groupBy("customer_id", "part_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity_hundredths").alias("quantity"),
        F.sum("discount_bp").alias("discount"),
    )


def basket(purchases: DataFrame, lines: DataFrame, day: str | dt.date) -> DataFrame:
    """Lines, quantity, distinct parts and mean discount per customer."""
    return _per_part(_customer_lines(purchases, lines, day)).groupBy("customer_id").agg(*_basket(F.count(F.lit(1))))


def _per_type(bought: DataFrame, *keys: str) -> DataFrame:
    """Lines added up per ``keys`` and part type; null where the part or its type is not known."""
    return bought.groupBy(*keys, "part_type").agg(
        *[F.sum(c).alias(c) for c in ("lines", "quantity", "discount")], F.count(F.lit(1)).alias("parts")
    )


def _mix() -> Column:
    """The quantities of all part types, as many as there are types."""
    return F.collect_list(F.struct(F.coalesce("quantity", F.lit(0)).alias("q"), F.col("part_type").alias("t"))).alias("_q")


def _mix_shares(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """Shares of all quantities in ``_q``. Types that are not in ``types`` and unknown ones count in
    the total, the entropy and the favourite, each as a type, and share ``share_other``."""
    def add(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda done, x: done + x["q"])

    names = F.array_distinct(F.transform("_q", lambda x: x["t"]))
    merged = F.transform(
        names, lambda t: F.struct(add(F.filter("_q", lambda x: x["t"].eqNullSafe(t))).alias("q"), t.alias("t"))
    )
    df = df.withColumn("_q", F.array_sort(merged)).withColumn("_total", add(F.col("_q")))
    total = F.col("_total")

    def share(wanted: Column) -> Column:
        return ratio(wanted, total)

    def quantity(kind: str) -> Column:
        return add(F.filter("_q", lambda x: x["t"] == kind))

    listed = [quantity(t) for t in types]
    other = add(F.filter("_q", lambda x: ~F.coalesce(x["t"].isin(*types), F.lit(False))))

    def term(done: Column, x: Column) -> Column:
        s = share(x["q"])
        return done + F.when(s > 0, -s * F.ln(s)).otherwise(0.0)

    # Ties go to the first name, unknown types last.
    best = F.array_min(F.transform("_q", lambda x: F.struct((-x["q"]).alias("q"), x["t"].isNull().alias("n"), x["t"].alias("t"))))
    return df.select(
        *[c for c in df.columns if c not in ("_q", "_total")],
        *[share(q).alias(f"share_{t.lower()}") for q, t in zip(listed, types)],
        share(other).alias("share_other"),
        F.aggregate("_q", F.lit(0.0), term).alias("mix_entropy"),
        F.when(total > 0, best["t"]).alias("favourite_type"),
    )


def mix(
    purchases: DataFrame,
    lines: DataFrame,
    parts: DataFrame,
    day: str | dt.date,
    types: Sequence[str] = PART_TYPES,
) -> DataFrame:
    """Share of quantity per part type, entropy of the shares and the favourite type."""
    bought = _per_part(_customer_lines(purchases, lines, day)).join(parts, "part_id", "left")
    return _mix_shares(_per_type(bought, "customer_id").groupBy("customer_id").agg(_mix()), types)


def line_features(
    purchases: DataFrame,
    lines: DataFrame,
    parts: DataFrame,
    day: str | dt.date,
    types: Sequence[str] = PART_TYPES,
) -> DataFrame:
    """Basket and mix in one pass over the lines."""
    bought = _per_part(_customer_lines(purchases, lines, day)).join(parts, "part_id", "left")
    basket = _basket(F.sum("parts"))
    return _mix_shares(_per_type(bought, "customer_id").groupBy("customer_id").agg(*basket, _mix()), types)


def returns(purchases: DataFrame, lines: DataFrame, day: str | dt.date) -> DataFrame:
    """Share of returned lines. The flag carries no time of return, so it may tell of events
    after the snapshot: not part of the feature table."""
    returned = F.when(F.col("return_flag") == "R", 1).otherwise(0)
    return (
        _customer_lines(purchases, lines, day)
        .groupBy("customer_id")
        .agg(ratio(F.sum(returned), F.count(F.lit(1))).alias("return_share"))
    )


def peer(
    df: DataFrame,
    cols: Sequence[str],
    by: str,
    single_task_rows: int | None = None,
) -> DataFrame:
    """z-score ``<col>_z`` and percent rank ``<col>_pr`` of each column within ``by``."""
    ranks = {f"{c}_pr": (c, [by]) for c in cols}
    df = percent_ranks(df, ranks, single_task_rows)
    stats = df.groupBy(F.col(by).alias("_by")).agg(
        *[F.avg(F.col(c).cast("double")).alias(f"_mean_{c}") for c in cols],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"_sd_{c}") for c in cols],
    )
    # As a table of known size, so that few groups are broadcast.
    stats, _ = freeze(stats)
    return df.join(stats, F.col(by).eqNullSafe(F.col("_by"))).select(
        *df.columns,
        *[
            F.try_divide(F.col(c).cast("double") - F.col(f"_mean_{c}"), F.col(f"_sd_{c}")).alias(f"{c}_z")
            for c in cols
        ],
    )


def running_spend(purchases: DataFrame, days: int = 90) -> DataFrame:
    """Spend of the customer in the ``days`` days up to and including the day of each order.

    The frame runs over the customer's days, not orders, and is joined back to the orders.
    """
    span = W.partitionBy("customer_id").orderBy(F.unix_date("day")).rangeBetween(-days, 0)
    spent = by_day(purchases).select("customer_id", "day", money(F.sum("spend").over(span)).alias("spend_window"))
    return (
        purchases.withColumn("day", F.to_date("order_ts"))
        .join(spent, ["customer_id", "day"])
        .select("order_id", "customer_id", "order_ts", "cents", "spend_window")
    )


def impute_values(
    train: DataFrame,
    plan: Mapping[str, str | float],
    at_most: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """One row of fill values, learnt on the training rows: 'mean', 'median' or a constant."""
    medians = [c for c, how in plan.items() if how == "median"]
    fixed = train.agg(
        F.lit(1).alias("_one"),
        *[
            (F.avg(F.col(c).cast("double")) if how == "mean" else F.lit(float(how))).alias(c)
            for c, how in plan.items()
            if how != "median"
        ],
    )
    if not medians:
        return fixed.drop("_one")
    middle = quantiles(train, medians, [0.5], (), at_most, single_task_rows)
    wide = middle.agg(
        F.lit(1).alias("_one"),
        *[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in medians],
    )
    return fixed.join(wide, "_one").select(*plan)


def impute(df: DataFrame, values: DataFrame) -> DataFrame:
    """Fill NULLs from the one-row ``values`` and add ``<col>_missing`` flags."""
    fill = values.select(F.struct(*values.columns)).scalar()
    columns = set(values.columns)
    return df.select(
        *[
            F.coalesce(F.col(c).cast("double"), fill[c]).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ],
        *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in values.columns],
    )


def winsor_limits(
    train: DataFrame,
    cols: Sequence[str],
    lo: float = 0.01,
    hi: float = 0.99,
    at_most: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """One row with ``<col>_lo`` and ``<col>_hi``, exact percentiles of the training rows."""
    found = quantiles(train, cols, [lo, hi], (), at_most, single_task_rows)

    def pick(c: str, p: float, name: str) -> Column:
        here = (F.col("feature") == c) & (F.col("prob") == F.lit(float(p)))
        return F.max(F.when(here, F.col("value"))).alias(name)

    return found.agg(
        *[pick(c, lo, f"{c}_lo") for c in cols], *[pick(c, hi, f"{c}_hi") for c in cols]
    )


def winsorize(df: DataFrame, cols: Sequence[str], limits: DataFrame) -> DataFrame:
    """Pull values outside the limits to the limits; NULL stays NULL."""
    bound = limits.select(F.struct(*limits.columns)).scalar()

    def clip(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.when(value.isNotNull(), F.least(F.greatest(value, bound[f"{c}_lo"]), bound[f"{c}_hi"])).alias(c)

    return df.select(*[clip(c) if c in set(cols) else F.col(c) for c in df.columns])


def moments(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with ``<col>_mean`` and ``<col>_sd`` of the training rows."""
    return train.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in cols],
        *[F.stddev_samp(F.col(c).cast("double")).alias(f"{c}_sd") for c in cols],
    )


def standardize(df: DataFrame, cols: Sequence[str], stats: DataFrame) -> DataFrame:
    """Replace each column by (x - mean) / sd; NULL when the column is constant."""
    stat = stats.select(F.struct(*stats.columns)).scalar()
    chosen = set(cols)
    return df.select(
        *[
            F.try_divide(F.col(c).cast("double") - stat[f"{c}_mean"], stat[f"{c}_sd"]).alias(c)
            if c in chosen
            else F.col(c)
            for c in df.columns
        ]
    )


def encode(df: DataFrame, cols: Sequence[str], train: DataFrame) -> DataFrame:
    """Add ``<col>_index`` (alphabetical over ``train``, values unseen there last) and one-hot
    ``<col>_vec``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    indexer = StringIndexer(
        inputCols=list(cols),
        outputCols=[f"{c}_index" for c in cols],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )
    hot = OneHotEncoder(
        inputCols=[f"{c}_index" for c in cols],
        outputCols=[f"{c}_vec" for c in cols],
        handleInvalid="keep",
    )
    return Pipeline(stages=[indexer, hot]).fit(train).transform(df)
