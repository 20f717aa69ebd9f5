"""Customer segments: by rule and by clustering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.functions import percent_bucket, ratio
from lapsewise.operators.features import impute, impute_values
from lapsewise.operators.ranking import ntiles, quantiles
from lapsewise.session import freeze


def rfm5(
    rfm: DataFrame,
    by: Sequence[str] = (),
    at_most: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """Add quintiles ``r5, f5, m5``; 5 is best, ties go by customer id."""
    tie = ("customer_id", True)
    tiles = {
        "r5": [("recency", False), tie],
        "f5": [("frequency", True), tie],
        "m5": [("monetary", True), tie],
    }
    return ntiles(rfm, tiles, 5, by, at_most, single_task_rows)


def rule_segment(quintiled: DataFrame) -> DataFrame:
    r, f = F.col("r5"), F.col("f5")
    return quintiled.withColumn(
        "segment",
        F.when((r >= 4) & (f >= 4), "champions")
        .when((r >= 4) & (f <= 2), "new")
        .when((r <= 2) & (f >= 4), "at_risk")
        .when((r <= 2) & (f <= 2), "hibernating")
        .otherwise("regular"),
    )


def _vectors(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list]:
    wide = df.select(
        *[c for c in df.columns if c not in cols], *[F.col(c).cast("double").alias(c) for c in cols]
    )
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="error"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
    ]
    return wide, stages


def kmeans(df: DataFrame, cols: Sequence[str], k: int, seed: int = 7) -> tuple[PipelineModel, DataFrame]:
    """Fit k-means on standardized columns; return the model and ``df`` with ``cluster``."""
    wide, stages = _vectors(df, cols)
    cluster = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster")
    model = Pipeline(stages=[*stages, cluster]).fit(wide)
    return model, model.transform(wide).drop("_raw", "_features")


def choose_k(df: DataFrame, cols: Sequence[str], ks: Sequence[int], seed: int = 7) -> DataFrame:
    """``k, silhouette, best`` for each candidate; the vectors are built once."""
    wide, stages = _vectors(df.select(*cols), cols)
    vectors, _ = freeze(Pipeline(stages=stages).fit(wide).transform(wide).select("_features"))
    judge = ClusteringEvaluator(featuresCol="_features", predictionCol="cluster")
    found = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(vectors)
        found.append((k, float(judge.evaluate(model.transform(vectors)))))
    top = max(s for _, s in found)
    return df.sparkSession.createDataFrame(
        [(k, s, int(s == top)) for k, s in found], "k int, silhouette double, best int"
    )


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """``rows, rand``: how far two labellings of the same rows agree, 1 for the same groups and about
    0 for unrelated ones (Hubert & Arabie 1985), from the table of their label pairs. NULL is a
    label; undefined (both have one group, or each row its own) is 1, as the groups are the same.
    """
    cells = df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))

    def pairs(n: Column) -> Column:
        # Decimals, as squares of counts leave 64 bits soon.
        n = n.cast("decimal(19,0)")
        return (n * (n - F.lit(1).cast("decimal(1,0)"))).cast("decimal(38,0)").cast("double") / 2

    def side(label: str, name: str) -> DataFrame:
        return cells.groupBy(label).agg(F.sum("_n").alias("_n")).agg(F.sum(pairs(F.col("_n"))).alias(name))

    both = cells.agg(F.sum(pairs(F.col("_n"))).alias("_both"), F.sum("_n").alias("rows"))
    left, right = side("_a", "_left").scalar(), side("_b", "_right").scalar()
    counted = both.select("rows", "_both", left.alias("_left"), right.alias("_right")).where("rows > 0")
    expected = F.try_divide(F.col("_left") * F.col("_right"), pairs(F.col("rows")))
    most = (F.col("_left") + F.col("_right")) / 2
    rand = F.when(most == F.coalesce(expected, most), 1.0).otherwise((F.col("_both") - expected) / (most - expected))
    return counted.select("rows", rand.alias("rand"))


def stability(
    df: DataFrame, cols: Sequence[str], k: int, resamples: int = 5, percent: int = 80, seed: int = 7, salt: str = "resample"
) -> DataFrame:
    """``resample, rows, rand``: how far the clusters of all rows come back from hashed samples.

    A resample fits k-means on ``percent`` of the customers and labels all of them; the adjusted
    Rand index against the clusters of the whole table comes from counts of label pairs.
    """
    base, _ = freeze(df.select("customer_id", *cols))
    _, whole = kmeans(base, cols, k, seed)
    found = []
    for r in range(resamples):
        model, _ = kmeans(base.where(percent_bucket("customer_id", f"{salt}:{r}") < percent), cols, k, seed + 1 + r)
        wide, _ = _vectors(whole.withColumnRenamed("cluster", "_whole"), cols)
        found.append(adjusted_rand(model.transform(wide), "_whole", "cluster").select(F.lit(r).alias("resample"), "rows", "rand"))
    return reduce(DataFrame.unionByName, found)


def filled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``customer_id`` and ``cols`` with the median in place of NULL, as clustering needs them."""
    base, rows = freeze(df.select("customer_id", *[F.col(c).cast("double").alias(c) for c in cols]))
    values = impute_values(base, dict.fromkeys(cols, "median"), rows)
    return impute(base, values).select("customer_id", *cols)


def profile(
    df: DataFrame,
    segment: str,
    cols: Sequence[str],
    single_task_rows: int | None = None,
) -> DataFrame:
    """Size, share, churn rate and mean / median of each column per segment."""
    df, rows = freeze(df)
    sizes = df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("customers"),
        ratio(F.sum("churned"), F.count(F.lit(1))).alias("churn_rate"),
        *[ratio(F.sum(c), F.count(c)).alias(f"mean_{c}") for c in cols],
    )
    middle = quantiles(df, cols, [0.5], [segment], rows, single_task_rows)
    medians = middle.groupBy(segment).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"median_{c}") for c in cols]
    )
    everyone = df.agg(F.count(F.lit(1))).scalar()
    return sizes.join(medians, segment, "left").withColumn("share", ratio(F.col("customers"), everyone))


def migration(before: DataFrame, after: DataFrame) -> DataFrame:
    """Customers per (segment before, segment after); 'absent' on a side they are not in."""
    a = before.select("customer_id", F.col("segment").alias("segment_before"))
    b = after.select("customer_id", F.col("segment").alias("segment_after"))
    return (
        a.join(b, "customer_id", "full_outer")
        .groupBy(
            F.coalesce("segment_before", F.lit("absent")).alias("segment_before"),
            F.coalesce("segment_after", F.lit("absent")).alias("segment_after"),
        )
        .agg(F.count(F.lit(1)).alias("customers"))
    )


def cross_tab(df: DataFrame, a: str = "segment", b: str = "band", value: str = "value_at_risk") -> DataFrame:
    """Customers and value per (a, b) with all totals; ``all_<a>``/``all_<b>`` mark total rows."""
    finest = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    return finest.cube(a, b).agg(
        F.grouping(a).cast("int").alias(f"all_{a}"),
        F.grouping(b).cast("int").alias(f"all_{b}"),
        F.sum("_n").alias("customers"),
        F.sum("_v").alias(value),
    )
