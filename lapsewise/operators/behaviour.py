"""Reports on purchase behaviour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapsewise.functions import money, ratio
from lapsewise.operators.ranking import ntiles


def by_period(purchases: DataFrame, unit: str = "month") -> DataFrame:
    """Orders, buying customers, revenue and revenue growth per period.

    Customers are counted after a (period, customer) aggregation, which also sums the orders.
    """
    per_customer = purchases.groupBy(
        F.date_trunc(unit, "order_ts").cast("date").alias("period"), "customer_id"
    ).agg(F.count(F.lit(1)).alias("orders"), F.sum("cents").alias("_cents"))
    per_period = per_customer.groupBy("period").agg(
        F.sum("orders").alias("orders"),
        F.count("customer_id").alias("customers"),
        money(F.sum("_cents")).alias("revenue"),
    )
    # One row per calendar period.
    previous = F.lag("revenue").over(W.orderBy("period"))
    return per_period.withColumn("growth", ratio(F.col("revenue") - previous, previous))


def cohorts(purchases: DataFrame) -> DataFrame:
    """Customers of each first-purchase month who bought again ``age`` months later."""
    active = purchases.select(
        "customer_id",
        F.expr("cast(year(order_ts) * 12 + month(order_ts) - 1 as int)").alias("month_no"),
    ).distinct()
    # At most one row per calendar month in a customer's window.
    first = F.min("month_no").over(W.partitionBy("customer_id"))
    counted = (
        active.select(first.alias("first_no"), (F.col("month_no") - first).alias("age"))
        .groupBy("first_no", "age")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    size = F.max(F.when(F.col("age") == 0, F.col("customers"))).over(W.partitionBy("first_no"))
    month = F.make_date(
        F.floor(F.col("first_no") / 12).cast("int"), F.col("first_no") % 12 + 1, F.lit(1)
    )
    return counted.select(
        month.alias("cohort"), "age", "customers", ratio(F.col("customers"), size).alias("retention")
    )


def rollup_report(scored: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Customers, revenue and churn rate per ``dims`` with subtotals.

    ``level`` is the grouping id. The finest grain is totalled first, so that only its rows are
    multiplied by the subtotals.
    """
    finest = scored.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("monetary").alias("_revenue"),
        F.sum("churned").alias("_churned"),
    )
    return (
        finest.rollup(*dims)
        .agg(
            F.grouping_id().alias("level"),
            F.sum("_n").alias("customers"),
            F.sum("_revenue").alias("revenue"),
            F.sum("_churned").alias("_lost"),
        )
        .withColumn("churn_rate", ratio(F.col("_lost"), F.col("customers")))
        .drop("_lost")
    )


def concentration(
    df: DataFrame,
    value: str = "monetary",
    tiles: int = 10,
    at_most: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """Share of ``value`` held by each decile of customers, decile 1 the highest."""
    order = [(value, False), ("customer_id", True)]
    narrow = df.select("customer_id", value)
    tiled = ntiles(narrow, {"decile": order}, tiles, (), at_most, single_task_rows)
    held = tiled.groupBy("decile").agg(F.count(F.lit(1)).alias("customers"), F.sum(value).alias("held"))
    # One row per decile.
    running = W.orderBy("decile").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("held").over(W.partitionBy())
    return held.select(
        "decile",
        "customers",
        "held",
        ratio(F.col("held"), total).alias("share"),
        ratio(F.sum("held").over(running), total).alias("cumulative_share"),
    )
