"""Quality of scores: ``churned`` (0/1) against ``probability``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapsewise.functions import percent_bucket, ratio
from lapsewise.operators.ranking import global_rank, ntiles
from lapsewise.session import freeze

CLIP = 1e-6


def auc(
    scored: DataFrame,
    score: str = "probability",
    label: str = "churned",
    by: Sequence[str] = (),
    at_most: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """Tie-correct area under the ROC curve, per ``by``.

    Rows are first counted per distinct score; a positive beats the negatives below it and
    shares the negatives tied with it.
    """
    counts = scored.groupBy(*by, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    ranked = global_rank(counts, [F.col("_score")], by, ["_neg"], at_most, single_task_rows)
    # Half units keep the sums exact.
    twice = (2 * F.col("run__neg") - F.col("_neg")).cast("decimal(20,0)") * F.col("_pos")
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return ranked.groupBy(*by).agg(
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
        F.try_divide(F.sum(twice).cast("double"), 2.0 * pairs).alias("auc"),
    )


def metrics(
    scored: DataFrame, thresholds: Sequence[float], score: str = "probability", label: str = "churned"
) -> DataFrame:
    """Confusion counts, precision, recall, F1, log loss and Brier score per threshold.

    All thresholds are counted in one pass over the scores.
    """
    p, y = F.col(score), F.col(label)
    safe = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    counts = []
    for i, t in enumerate(thresholds):
        counts += [
            F.count_if((p >= t) & (y == 1)).alias(f"tp{i}"),
            F.count_if((p >= t) & (y == 0)).alias(f"fp{i}"),
        ]
    wide = scored.agg(
        F.count_if(y == 1).alias("pos"),
        F.count_if(y == 0).alias("neg"),
        F.avg(-(y * F.ln(safe) + (1 - y) * F.ln(1 - safe))).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"),
        *counts,
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")
            )
            for i, t in enumerate(thresholds)
        ]
    )
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("pos") - tp
    return wide.select("pos", "neg", "log_loss", "brier", F.inline(rows)).select(
        "threshold",
        "tp",
        "fp",
        (F.col("neg") - fp).alias("tn"),
        fn.alias("fn"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("pos")).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "log_loss",
        "brier",
    )


def lift(
    scored: DataFrame,
    tiles: int = 10,
    score: str = "probability",
    label: str = "churned",
    at_most: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """Churn rate, lift and cumulative gain per score decile, decile 1 the highest scores."""
    order = [(score, False), ("customer_id", True)]
    narrow = scored.select("customer_id", score, label)
    tiled = ntiles(narrow, {"decile": order}, tiles, (), at_most, single_task_rows)
    per = tiled.groupBy("decile").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(label).cast("bigint").alias("churners")
    )
    # One row per decile.
    whole = W.partitionBy()
    running = W.orderBy("decile").rowsBetween(W.unboundedPreceding, W.currentRow)
    rate = ratio(F.col("churners"), F.col("customers"))
    base = ratio(F.sum("churners").over(whole), F.sum("customers").over(whole))
    return per.select(
        "decile",
        "customers",
        "churners",
        rate.alias("churn_rate"),
        F.try_divide(rate, base).alias("lift"),
        ratio(F.sum("churners").over(running), F.sum("churners").over(whole)).alias("gain"),
    )


def reliability(
    scored: DataFrame, bins: int = 10, score: str = "probability", label: str = "churned"
) -> DataFrame:
    """Mean score against observed rate per equal-width bin."""
    bin_no = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(score).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("observed"),
    )


def fit_calibration(
    scored: DataFrame, score: str = "probability", label: str = "churned", cells: int | None = None
) -> IsotonicRegressionModel:
    """Isotonic map from score to observed rate.

    Equal scores are one weighted point, counted in tasks, and every distinct score is a point of
    its own. The learner pools them range by range and once more across the ranges' blocks; rates
    of 0/1 labels that rise from block to block differ, and n rows have fewer than n ** (2/3)
    different ones, so what the driver gets from a range is bounded by that. With ``cells`` scores
    are first gathered in as many cells of about equal numbers of rows, for a coarser curve.
    """
    points = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("_s")).agg(
        F.sum(F.col(label).cast("bigint")).alias("_ones"), F.count(F.lit(1)).alias("_n")
    )
    if cells is not None:
        ranked = global_rank(points, [F.col("_s")], (), ["_n"])
        cell = F.floor((F.col("run__n") - F.col("_n")) * cells / F.col("all__n"))
        points = ranked.groupBy(cell.alias("_cell")).agg(
            (F.sum(F.col("_s") * F.col("_n")) / F.sum("_n")).alias("_s"), F.sum("_ones").alias("_ones"), F.sum("_n").alias("_n")
        )
    weighted = points.select(
        F.col("_s").cast("double").alias("_x"), (F.col("_ones") / F.col("_n")).alias("_y"), F.col("_n").cast("double").alias("_w")
    )
    return IsotonicRegression(
        featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="_calibrated"
    ).fit(weighted)


def calibrate(
    scored: DataFrame, model: IsotonicRegressionModel, score: str = "probability"
) -> DataFrame:
    """Add ``calibrated`` in [0, 1]."""
    return (
        model.transform(scored.withColumn("_x", F.col(score)))
        .withColumnRenamed("_calibrated", "calibrated")
        .drop("_x")
    )


def calibrate_crosswise(
    scored: DataFrame, folds: int = 5, salt: str = "calibration", score: str = "probability", label: str = "churned"
) -> DataFrame:
    """Add ``calibrated``, each row's from a curve fitted on the other folds, so that no row judges
    itself. Folds follow a hash of the customer. Rows without a label are calibrated but never
    learnt from; where the other folds have no labelled row, ``calibrated`` is NULL."""
    rows, _ = freeze(scored.withColumn("_fold", percent_bucket("customer_id", salt) % folds))
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy("_fold").count()
    labelled = {r["_fold"]: r["count"] for r in known.collect()}
    out = []
    for k in range(folds):
        mine = rows.where(F.col("_fold") == k)
        if sum(n for fold, n in labelled.items() if fold != k):
            out.append(calibrate(mine, fit_calibration(rows.where(F.col("_fold") != k), score, label), score))
        else:
            out.append(mine.withColumn("calibrated", F.lit(None).cast("double")))
    return reduce(DataFrame.unionByName, out).drop("_fold")
