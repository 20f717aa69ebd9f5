"""Order-dependent numbers over groups of any size, without sorting a group in one task.

A plain ``Window.orderBy`` without partition, or partitioned by a key that holds a large part
of the rows, sorts that part in a single task. Here the rows are range-partitioned by
(group, order), frozen, and numbered inside each range; only one summary row per range is
ordered globally. The plain window, which gives the same rows, is a plan for up to
``SINGLE_TASK_ROWS`` rows: only where the caller passes a proven bound ``at_most`` (say, the size
of the customer table for one row per customer). Tests compare both on nulls and ties.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapsewise.session import freeze

SINGLE_TASK_ROWS = 200_000
ROWS_PER_RANGE = 2_000_000
# One summary row per range is broadcast up to this many ranges, and joined by shuffling beyond.
BROADCAST_RANGES = 100_000
_LOW_BITS = (1 << 33) - 1


def settle(
    df: DataFrame, at_most: int | None = None, single_task_rows: int | None = None
) -> tuple[DataFrame, int]:
    """``df`` and a bound on its rows: as it is when known to be small, else frozen and counted."""
    limit = SINGLE_TASK_ROWS if single_task_rows is None else single_task_rows
    if at_most is not None and at_most <= limit:
        return df, at_most
    return freeze(df)


def global_rank(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    sums: Sequence[str] = (),
    at_most: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """Add ``rn`` (row number within ``by``), ``rn_rows`` (rows in the group) and, for each
    column in ``sums``, the inclusive running sum ``run_<column>`` and the group's ``all_<column>``.

    ``order`` must be a total order within a group. Summed columns must be exact (integer or
    decimal). NULL adds nothing; a running sum is NULL until the group's first value, as with a
    plain window, and ``all_`` is NULL for a group without any.
    """
    limit = SINGLE_TASK_ROWS if single_task_rows is None else single_task_rows
    if at_most is not None and at_most <= limit:
        return _plain(df, order, by, sums)
    return _ranged(df, order, by, sums, at_most)


def _plain(df: DataFrame, order: Sequence[Column], by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    group = W.partitionBy(*by)
    ordered = group.orderBy(*order)
    running = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.select(
        "*",
        F.row_number().over(ordered).cast("bigint").alias("rn"),
        F.count(F.lit(1)).over(group).alias("rn_rows"),
        *[F.sum(c).over(running).alias(f"run_{c}") for c in sums],
        *[F.sum(c).over(group).alias(f"all_{c}") for c in sums],
    )


def _ranged(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str],
    sums: Sequence[str],
    at_most: int | None = None,
) -> DataFrame:
    spark = df.sparkSession
    ranges = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((at_most or 0) / ROWS_PER_RANGE)
    )
    keys = [*[F.col(c).asc() for c in by], *order]
    # Frozen, since the range number of a row must never change once offsets are derived from it.
    placed, rows = freeze(
        df.repartitionByRange(ranges, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    # Per summed column its values, NULL as 0, and how many there are.
    zero = {c: F.lit(0).cast(df.schema[c].dataType) for c in sums}
    placed = placed.select(
        "*",
        *[F.coalesce(F.col(c), zero[c]).alias(f"_v_{c}") for c in sums],
        *[F.col(c).isNotNull().cast("bigint").alias(f"_k_{c}") for c in sums],
    )
    parts = [f"_{kind}_{c}" for c in sums for kind in ("v", "k")]
    # At most one row per range.
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(x).alias(f"_sum{x}") for x in parts]
    )
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        *[F.coalesce(F.sum(f"_sum{x}").over(before), F.lit(0)).alias(f"_base{x}") for x in parts],
        *[F.sum(f"_sum{x}").over(W.partitionBy()).alias(f"_all{x}") for x in parts],
    )
    if ranges <= BROADCAST_RANGES:
        offsets = F.broadcast(offsets)
    if sums:
        inside = W.partitionBy("_range").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = placed.select("*", *[F.sum(x).over(inside).alias(f"_in{x}") for x in parts])
    numbered = placed.join(offsets, "_range").select(
        *df.columns,
        (F.col("_offset") + F.col("_at").bitwiseAND(F.lit(_LOW_BITS)) + 1).alias("_global"),
        *[(F.col(f"_in{x}") + F.col(f"_base{x}")).alias(f"_run{x}") for x in parts],
        *[f"_all{x}" for x in parts],
        *parts,
    )

    def present(count: str, total: str) -> Column:
        return F.when(F.col(count) > 0, F.col(total))

    if not by:
        return numbered.select(
            *df.columns,
            F.col("_global").alias("rn"),
            F.lit(rows).cast("bigint").alias("rn_rows"),
            *[present(f"_run_k_{c}", f"_run_v_{c}").alias(f"run_{c}") for c in sums],
            *[present(f"_all_k_{c}", f"_all_v_{c}").alias(f"all_{c}") for c in sums],
        )
    starts = numbered.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(
        (F.min("_global") - 1).alias("_start"),
        F.count(F.lit(1)).alias("rn_rows"),
        *[F.min_by(F.col(f"_run{x}") - F.col(x), "_global").alias(f"_start{x}") for x in parts],
        *[F.sum(c).alias(f"all_{c}") for c in sums],
    )
    # As a table of known size: few groups are broadcast, and the rows are not shuffled by group.
    starts, _ = freeze(starts)
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return numbered.join(starts, same).select(
        *df.columns,
        (F.col("_global") - F.col("_start")).alias("rn"),
        "rn_rows",
        *[
            F.when(
                F.col(f"_run_k_{c}") > F.col(f"_start_k_{c}"), F.col(f"_run_v_{c}") - F.col(f"_start_v_{c}")
            ).alias(f"run_{c}")
            for c in sums
        ],
        *[f"all_{c}" for c in sums],
    )


def ntiles(
    df: DataFrame,
    tiles: Mapping[str, Sequence[tuple[str, bool]]],
    k: int,
    by: Sequence[str] = (),
    at_most: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """Add one ``ntile(k)`` column per entry of ``tiles``: name -> total order of
    (column, ascending).

    A tile is fixed by its last row. Beyond the size switch only the order columns are ranked;
    the k - 1 cuts are then compared with each full row where it lies, without moving it.
    """
    df, rows = settle(df, at_most, single_task_rows)
    limit = SINGLE_TASK_ROWS if single_task_rows is None else single_task_rows
    if rows <= limit:
        group = W.partitionBy(*by)
        return df.select(
            "*",
            *[F.ntile(k).over(group.orderBy(*_keys(order))).alias(name) for name, order in tiles.items()],
        )
    out = df
    for name, order in tiles.items():
        cols = [c for c, _ in order]
        ranked = _ranged(df.select(*by, *cols), _keys(order), by, (), rows)
        small, extra = F.floor(F.col("rn_rows") / k), F.col("rn_rows") % k
        ends = [F.lit(j) * small + F.least(F.lit(j), extra) for j in range(1, k)]
        cuts = (
            ranked.where(F.col("rn").isin(*ends))
            .groupBy(*[F.col(c).alias(f"_by_{c}") for c in by])
            .agg(F.collect_list(F.struct(*cols)).alias("_cuts"))
        )
        kept = out.columns
        if by:
            cuts, _ = freeze(cuts)
            out = out.join(cuts, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
        else:
            out = out.withColumn("_cuts", cuts.scalar())
        passed = [
            F.when((F.size("_cuts") > j) & _after(order, F.get("_cuts", F.lit(j))), 1).otherwise(0)
            for j in range(k - 1)
        ]
        out = out.select(*kept, sum(passed, F.lit(1)).alias(name))
    return out


def _keys(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if ascending else F.col(c).desc() for c, ascending in order]


def _after(order: Sequence[tuple[str, bool]], cut: Column) -> Column:
    """Whether a row comes after ``cut``; NULL is the smallest value, as in sorting."""
    later = F.lit(False)
    for c, ascending in reversed(order):
        high, low = (F.col(c), cut[c]) if ascending else (cut[c], F.col(c))
        beyond = F.coalesce(high > low, high.isNotNull() & low.isNull())
        later = beyond | (F.col(c).eqNullSafe(cut[c]) & later)
    return later


def percent_ranks(
    df: DataFrame,
    ranks: Mapping[str, tuple[str, Sequence[str]]],
    single_task_rows: int | None = None,
) -> DataFrame:
    """Add SQL ``percent_rank()`` columns: name -> (column ranked ascending, its group).

    Ranks are worked out on the distinct values only, so ties never have to meet in one task.
    ``df`` is read once per rank and once for the result, so it is frozen first.
    """
    df, rows = freeze(df)
    out = df
    for name, (value, by) in ranks.items():
        values = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
        placed = global_rank(values, [F.col(value)], by, ["_ties"], rows, single_task_rows)
        below = (F.col("run__ties") - F.col("_ties")).cast("double")
        rank = F.when(F.col("all__ties") > 1, below / (F.col("all__ties") - 1)).otherwise(F.lit(0.0))
        table = placed.select(
            *[F.col(c).alias(f"_by_{c}") for c in by], F.col(value).alias("_value"), rank.alias(name)
        )
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        kept = out.columns
        out = out.join(table, [*same, F.col(value).eqNullSafe(F.col("_value"))]).select(*kept, name)
    return out


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    at_most: int | None = None,
    single_task_rows: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles, one row per (``by``, column, prob): ``feature, prob, value``.

    All columns go through a single ranking of their distinct values, with the column name as
    part of the group.
    """
    cells = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols
    ]
    group = [*by, "feature"]
    values = (
        df.select(*by, F.inline(F.array(*cells)))
        .where("value is not null")
        .groupBy(*group, "value")
        .agg(F.count(F.lit(1)).alias("_ties"))
    )
    bound = None if at_most is None else at_most * len(cols)
    ranked = global_rank(values, [F.col("value")], group, ["_ties"], bound, single_task_rows)
    spots = ranked.select(
        *group,
        "value",
        (F.col("run__ties") - F.col("_ties")).alias("_first"),
        (F.col("run__ties") - 1).alias("_last"),
        F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"),
        "all__ties",
    ).withColumn("_place", F.col("prob") * (F.col("all__ties") - 1))
    lower = F.floor("_place")
    near = spots.where((F.col("_first") <= lower + 1) & (F.col("_last") >= lower))
    lo = F.max(F.when((F.col("_first") <= lower) & (F.col("_last") >= lower), F.col("value")))
    hi = F.max(F.when((F.col("_first") <= lower + 1) & (F.col("_last") >= lower + 1), F.col("value")))
    weight = F.max(F.col("_place") - lower)
    return near.groupBy(*group, "prob").agg(
        F.when(weight > 0, lo + (hi - lo) * weight).otherwise(lo).alias("value")
    )
