"""Risk scores, bands and the revenue behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.operators.ranking import global_rank, percent_ranks

BANDS = ("low", "medium", "high", "critical")
CUTS = (25, 50, 75)
# Weight of each quintile in the model-free score, in percent.
RULE_WEIGHTS = {"r5": 50, "f5": 30, "m5": 20}


def risk_score(scored: DataFrame, probability: str = "probability") -> DataFrame:
    """Add ``risk`` 0-100 from a calibrated churn probability."""
    return scored.withColumn("risk", F.round(100 * F.col(probability), 2))


def rule_risk(quintiled: DataFrame) -> DataFrame:
    """Add ``risk`` 0-100 from RFM quintiles: recency weighs 0.5, frequency 0.3, spend 0.2."""
    points = sum((w * (5 - F.col(q)) for q, w in RULE_WEIGHTS.items()), F.lit(0))
    return quintiled.withColumn("risk", points.cast("double") / F.lit(4.0))


def risk_band(df: DataFrame, cuts: Sequence[float] = CUTS) -> DataFrame:
    """Add ``band``; a score equal to a cut belongs to the band above it."""
    band = F.lit(BANDS[-1])
    for cut, name in reversed(list(zip(cuts, BANDS))):
        band = F.when(F.col("risk") < cut, name).otherwise(band)
    return df.withColumn("band", F.when(F.col("risk").isNotNull(), band))


def value_at_risk(df: DataFrame, spend: str = "spend_365") -> DataFrame:
    """Add ``value_at_risk``: risk as a fraction of the trailing spend, exact in cents."""
    share = F.col("risk").cast("decimal(7,2)") / F.lit(100).cast("decimal(3,0)")
    return df.withColumn(
        "value_at_risk", F.round(share * F.col(spend).cast("decimal(18,2)"), 2).cast("decimal(18,2)")
    )


def value_at_risk_by(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    return df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("value_at_risk").alias("value_at_risk")
    )


def risk_rank(
    df: DataFrame,
    within: str = "region",
    at_most: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """Add ``overall_rank`` (1 = highest risk), ``overall_pr`` and ``<within>_pr``."""
    kept = df.columns
    order = [F.col("risk").desc(), F.col("customer_id")]
    ranked = global_rank(df, order, (), (), at_most, single_task_rows)
    ranked = ranked.select(*kept, F.col("rn").alias("overall_rank"))
    ranks = {"overall_pr": ("risk", ()), f"{within}_pr": ("risk", [within])}
    return percent_ranks(ranked, ranks, single_task_rows)
