"""Predictions as a table that other jobs look up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predictions(history: DataFrame, key: Sequence[str] = ("customer_id",)) -> DataFrame:
    """The latest row per ``key`` (say, customer and model) of a history with ``snapshot``.

    Rows that share a snapshot are ordered by their other columns, so the answer is fixed.
    """
    rest = [c for c in history.columns if c not in (*key, "snapshot")]
    latest = F.max(F.struct("snapshot", *rest))
    return history.groupBy(*key).agg(latest.alias("_row")).select(*key, "_row.*")


def lookup(predicted: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer each request with the prediction, ``found`` = 0 for unknown ids.

    The table is cut down to the requested ids first: for a short list that semi join is a
    broadcast of the ids and the large table is never shuffled.
    """
    ids = requests.select("customer_id").distinct()
    hits = predicted.join(ids, "customer_id", "left_semi").withColumn("_hit", F.lit(1))
    return requests.join(hits, "customer_id", "left").withColumn(
        "found", F.coalesce("_hit", F.lit(0))
    ).drop("_hit")
