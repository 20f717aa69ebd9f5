"""Churn labels and training splits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.functions import as_date, at, iso, percent_bucket


def churn_label(purchases: DataFrame, day: str | dt.date, horizon: int) -> DataFrame:
    """``customer_id, churned`` for everyone who bought before ``day``: 1 when nothing was
    bought in the ``horizon`` days from ``day`` on. One aggregation, no join."""
    before = F.col("order_ts") < at(day)
    return (
        purchases.where(F.col("order_ts") < at(day, horizon))
        .groupBy("customer_id")
        .agg(F.bool_or(before).alias("_bought"), F.bool_and(before).alias("_lapsed"))
        .where("_bought")
        .select("customer_id", F.col("_lapsed").cast("int").alias("churned"))
    )


def guard(purchases: DataFrame, snaps: Sequence[str | dt.date], horizon: int) -> DataFrame:
    """Mark snapshots whose label window runs past the data: ``censored``."""
    ends = [(as_date(s), as_date(s) + dt.timedelta(days=horizon)) for s in snaps]
    windows = F.array(
        *[F.struct(F.lit(s).alias("snapshot"), F.lit(e).alias("window_end")) for s, e in ends]
    )
    last = purchases.agg(F.to_date(F.max("order_ts")).alias("data_end"))
    return last.select("data_end", F.inline(windows)).select(
        iso("snapshot").alias("snapshot"),
        iso("window_end").alias("window_end"),
        iso("data_end").alias("data_end"),
        (F.col("window_end") > F.col("data_end")).cast("int").alias("censored"),
    )


def split_by_key(
    df: DataFrame, key: str = "customer_id", train_percent: int = 70, salt: str = "split"
) -> DataFrame:
    """Add ``split`` from a hash of the key: a customer is always on the same side."""
    side = F.when(percent_bucket(key, salt) < train_percent, "train").otherwise("test")
    return df.withColumn("split", side)


def split_by_time(df: DataFrame, first_test_day: str | dt.date, snapshot: str = "snapshot") -> DataFrame:
    """Add ``split``: snapshots from ``first_test_day`` on are the test side."""
    later = F.col(snapshot) >= F.lit(as_date(first_test_day))
    return df.withColumn("split", F.when(later, "test").otherwise("train"))


def class_weight(df: DataFrame, label: str = "churned") -> DataFrame:
    """Add ``weight`` = rows / (2 x rows of the class)."""
    sizes = df.select(
        F.struct(
            F.count(F.lit(1)).alias("all"),
            F.count_if(F.col(label) == 1).alias("ones"),
            F.count_if(F.col(label) == 0).alias("zeros"),
        ).alias("s")
    ).scalar()
    of_class = F.when(F.col(label) == 1, sizes["ones"]).otherwise(sizes["zeros"])
    return df.withColumn("weight", sizes["all"].cast("double") / (2.0 * of_class))
