"""The purchase facts and the grains derived from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.functions import at, money


def facts(purchases: DataFrame, lines: DataFrame, customers: DataFrame, places: DataFrame) -> DataFrame:
    """One row per order of a known customer, with its line totals and the customer's place.

    Lines are totalled per order before they meet the orders; orders without lines stay.
    """
    per_order = lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity_hundredths").alias("_quantity")
    )
    who = customers.join(places, "nation_id", "left").select(
        "customer_id", "market_segment", "nation", "region"
    )
    return (
        purchases.join(per_order, "order_id", "left")
        .join(who, "customer_id")
        .select(
            "order_id", "customer_id", "order_ts", "cents", "lines", money("_quantity").alias("quantity"),
            "market_segment", "nation", "region",
        )
    )


def as_of(df: DataFrame, day: str | dt.date) -> DataFrame:
    """Only what was known before ``day``; every feature goes through this cut."""
    return df.where(F.col("order_ts") < at(day))


def by_day(purchases: DataFrame) -> DataFrame:
    """``customer_id, day, orders, spend`` (in cents): bounded per customer by the calendar."""
    return purchases.groupBy("customer_id", F.to_date("order_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("cents").alias("spend")
    )
