"""Approximate quantiles from sketches that are kept per day and merged for any span of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; the rank error follows from it.
K = 800


def rank_error(k: int = K) -> float:
    """Bound on the normalised rank error of one quantile, at 99 % confidence, whatever the number
    of values and of merges (the sketch library's own fit for its KLL sketches)."""
    return 2.296 / k**0.9021


def daily_sketches(df: DataFrame, day: Column | str, cols: Sequence[str], k: int = K) -> DataFrame:
    """``day, feature, sketch`` of every column and day: one small binary for each, built in tasks and
    merged after the shuffle. NULLs are not counted; a day without values has no row. A table of
    them is extended by the new days only."""
    day = F.col(day) if isinstance(day, str) else day
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]
    values = df.select(day.alias("day"), F.inline(F.array(*cells))).where("value is not null and not isnan(value)")
    return values.groupBy("day", "feature").agg(F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = (), k: int = K) -> DataFrame:
    """``by, feature, prob, value, n``: quantiles of all the sketches of a group, each within
    ``rank_error(k)`` of its rank. Filter the sketches by day before."""
    merged = sketches.groupBy(*by, "feature").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"))
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    values = F.kll_sketch_get_quantile_double("_s", wanted)
    cells = F.arrays_zip(wanted.alias("prob"), values.alias("value"))
    return merged.select(*by, "feature", F.kll_sketch_get_n_double("_s").alias("n"), F.explode(cells).alias("_c")).select(
        *by, "feature", "_c.prob", "_c.value", "n"
    )


def sketched_limits(sketches: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99, k: int = K) -> DataFrame:
    """As ``features.winsor_limits``, from sketches: what ``features.winsorize`` takes."""
    found = sketched_quantiles(sketches, [lo, hi], (), k)

    def pick(c: str, p: float, name: str) -> Column:
        return F.max(F.when((F.col("feature") == c) & (F.col("prob") == F.lit(float(p))), F.col("value"))).alias(name)

    return found.agg(*[pick(c, lo, f"{c}_lo") for c in cols], *[pick(c, hi, f"{c}_hi") for c in cols])
