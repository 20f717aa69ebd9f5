"""Contributions of features to a customer's score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapsewise.operators.models import as_doubles, score
from lapsewise.session import freeze


def _long(df: DataFrame, parts: Mapping[str, Column]) -> DataFrame:
    cells = [
        F.struct(F.lit(name).alias("feature"), part.cast("double").alias("contribution"))
        for name, part in parts.items()
    ]
    return df.select("customer_id", F.inline(F.array(*cells)))


def linear_contributions(
    df: DataFrame, weights: Mapping[str, float], means: DataFrame
) -> DataFrame:
    """Exact Shapley values of a linear margin, ``w (x - mean)``; ``means`` has ``<col>_mean``."""
    mean = means.select(F.struct(*means.columns)).scalar()
    return _long(
        df,
        {c: F.lit(float(w)) * (F.col(c).cast("double") - mean[f"{c}_mean"]) for c, w in weights.items()},
    )


def explain_linear(model: PipelineModel, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``customer_id, feature, contribution`` of a fitted logistic model.

    Contributions and the intercept add up to the margin; the base customer is the training
    mean, to which missing values are filled.
    """
    _, _, scaler, logistic = model.stages
    parts = {}
    for c, w, mu, sd in zip(cols, logistic.coefficients, scaler.mean, scaler.std):
        slope = float(w) / float(sd) if sd > 0 else 0.0
        parts[c] = F.lit(slope) * (F.coalesce(F.col(c).cast("double"), F.lit(float(mu))) - F.lit(float(mu)))
    return _long(df, parts)


def background(df: DataFrame, cols: Sequence[str], size: int, salt: str = "background") -> DataFrame:
    """``size`` customers drawn by hash, to stand for 'feature unknown'."""
    key = F.md5(F.concat(F.lit(salt), F.lit(":"), F.col("customer_id").cast("string")))
    return as_doubles(df, cols).orderBy(key, "customer_id").limit(size).select(*cols)


def _draws(df: DataFrame, cols: Sequence[str], rows: Column, salt: str) -> DataFrame:
    """One row per customer and background row of the array ``rows``: the customer's values
    ``_x_``, the background's ``_bg`` and an order of the features drawn by hash.

    Customers are dealt to all tasks, since a few files of them become many rows to score."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = as_doubles(df.select("customer_id", *cols), cols).repartition(parts).select(
        "customer_id",
        *[F.col(c).alias(f"_x_{c}") for c in cols],
        F.posexplode(rows).alias("_perm", "_bg"),
        F.size(rows).alias("_perms"),
    )
    name = F.concat_ws(":", F.lit(salt), F.col("customer_id").cast("string"), F.col("_perm").cast("string"))
    # Sorted and read without lambdas, which are not compiled.
    hashed = F.array(*[F.struct(F.md5(F.concat(name, F.lit(f":{c}"))).alias("h"), F.lit(c).alias("c")) for c in cols])
    return draws.withColumn("_order", F.sort_array(hashed)["c"])


def _switched(model: PipelineModel, draws: DataFrame, cols: Sequence[str], of: str, *kept: str) -> DataFrame:
    """``customer_id``, ``kept``, ``feature, v``: the model is asked after every switch of a feature
    from the background's to the customer's value; an answer counts for the feature switched last
    and against the one switched next."""
    # Places of the features are looked up once a draw, not at every step.
    places = F.struct(*[F.array_position("_order", c).cast("int").alias(c) for c in cols])
    steps = draws.withColumn("_at", places).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(cols)))).alias("_step"))
    coalition = steps.select(
        "customer_id",
        *kept,
        F.when(F.col("_step") > 0, F.get("_order", F.col("_step") - 1)).alias("_last"),
        F.get("_order", F.col("_step")).alias("_next"),
        *[
            F.when(F.col("_at")[c] <= F.col("_step"), F.col(f"_x_{c}"))
            .otherwise(F.col("_bg")[f"_b_{c}"])
            .alias(c)
            for c in cols
        ],
    )
    signed = F.array(
        F.struct(F.col("_last").alias("feature"), F.col(of).alias("v")),
        F.struct(F.col("_next").alias("feature"), (-F.col(of)).alias("v")),
    )
    return score(model, coalition, cols).select("customer_id", *kept, F.inline(signed)).where("feature is not null")


def _as_array(reference: DataFrame, cols: Sequence[str]) -> Column:
    wide = as_doubles(reference, cols)
    return wide.agg(F.collect_list(F.struct(*[F.col(c).alias(f"_b_{c}") for c in cols]))).scalar()


def explain_sampled(
    model: PipelineModel, df: DataFrame, cols: Sequence[str], reference: DataFrame, salt: str = "order"
) -> DataFrame:
    """Sampled Shapley values of any model's probability.

    ``reference`` holds one background row per permutation (a fixed, small number). For each
    (customer, permutation) the features are switched from the background's to the customer's
    one by one, in an order drawn by hash. A scored row counts for the feature switched last
    and against the one switched next, so the differences need no ordering: they are one sum
    per (customer, feature), combined map-side. They add up to f(x) - mean f(background).
    """
    draws = _draws(df, cols, _as_array(reference, cols), salt)
    return (
        _switched(model, draws, cols, "probability", "_perms")
        .groupBy("customer_id", "feature")
        .agg((F.sum("v") / F.first("_perms")).alias("contribution"))
    )


def explain_with_errors(
    model: PipelineModel,
    df: DataFrame,
    cols: Sequence[str],
    reference: DataFrame,
    tolerance: float,
    pairs: int = 8,
    of: str = "probability",
    salt: str = "order",
) -> DataFrame:
    """Sampled Shapley values with their standard errors: ``customer_id, feature, contribution,
    error, draws``, of the model's ``probability`` or ``margin``.

    A draw takes one row of ``reference`` and an order of the features, and walks through the
    order forwards and backwards: what one way overrates by its place the other underrates, so the
    mean of both varies less. The error is that of a mean of independent draws. Rounds of ``pairs``
    draws go on for the customers of whom some error is above ``tolerance``, each round with the
    next rows of ``reference``, until it is used up; so a customer near the background is done early.
    """
    reference, size = freeze(reference)
    key = F.md5(F.concat(F.lit(f"{salt}:"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    order = W.orderBy(key, *cols)  # a background is small by its nature
    numbered = as_doubles(reference, cols).withColumn("_no", F.row_number().over(order) - 1)
    open_, _ = freeze(df.select("customer_id", *cols))
    sums: list[DataFrame] = []
    for begin in range(0, size, pairs):
        some = numbered.where(F.col("_no").between(begin, begin + pairs - 1)).drop("_no")
        draws = _draws(open_, cols, _as_array(some, cols), f"{salt}:{begin}")
        both = draws.withColumn("_order", F.explode(F.array("_order", F.reverse("_order"))))
        per_draw = (
            _switched(model, both, cols, of, "_perm").groupBy("customer_id", "_perm", "feature").agg((F.sum("v") / 2).alias("c"))
        )
        part = per_draw.groupBy("customer_id", "feature").agg(
            F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss")
        )
        sums.append(freeze(part)[0])
        whole = _with_error(reduce(DataFrame.unionByName, sums))
        still = whole.where((F.col("error") > tolerance) | F.col("error").isNull()).select("customer_id").distinct()
        open_, left = freeze(open_.join(still, "customer_id", "left_semi"))
        if not left:
            break
    return _with_error(reduce(DataFrame.unionByName, sums)) if sums else _no_contributions(df)


def _with_error(parts: DataFrame) -> DataFrame:
    total = parts.groupBy("customer_id", "feature").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    n, s, ss = F.col("n"), F.col("s"), F.col("ss")
    # A variance below nothing is a rounding error; one draw alone has none.
    variance = F.when(n > 1, F.greatest((ss - s * s / n) / (n - 1), F.lit(0.0)))
    return total.select("customer_id", "feature", (s / n).alias("contribution"), F.sqrt(variance / n).alias("error"), n.alias("draws"))


def _no_contributions(df: DataFrame) -> DataFrame:
    return df.limit(0).select(
        "customer_id", F.lit("").alias("feature"), F.lit(0.0).alias("contribution"), F.lit(0.0).alias("error"), F.lit(0).cast("bigint").alias("draws")
    )


def reasons(contributions: DataFrame, k: int) -> DataFrame:
    """The ``k`` features with the largest absolute contribution per customer, with ``place``."""
    order = W.partitionBy("customer_id").orderBy(F.abs("contribution").desc(), "feature")
    return contributions.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
