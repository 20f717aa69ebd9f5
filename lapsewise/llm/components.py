"""Connected components of a table of links, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.session import freeze


def connected(links: DataFrame) -> DataFrame:
    """``node, label``: for every node of ``links`` (``a``, ``b``, any orderable type) the
    smallest node that can be reached. Repeated links and loops are fine.

    A round takes the smallest label among the neighbours and then the label of that label, so
    chains shrink by half. Labels are written each round; hubs are split by the join, and minima
    are taken in tasks before rows move.
    """
    both, _ = freeze(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels, _ = freeze(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, F.col("node") == F.col("a")).select("node", F.least("label", "heard").alias("next"), "label")
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        after, _ = freeze(
            nearer.join(jump, F.col("next") == F.col("_n"), "left").select(
                "node", F.least("next", F.coalesce("_l", "next")).alias("label"),
                (F.least("next", F.coalesce("_l", "next")) != F.col("label")).alias("changed"),
            )
        )
        labels = after.select("node", "label")
        if not after.where("changed").limit(1).count():
            return labels
