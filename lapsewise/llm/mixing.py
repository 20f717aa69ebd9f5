"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapsewise.llm.common import WORD
from lapsewise.session import freeze

NEWTON_STEPS = 60
#: Documents lie in this many bins by hash, per source; only one bin is looked at row by row.
BINS = 1 << 16
HASH_BITS = 62


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``source, source_size`` and ``target``: sources in code-point order, null last, weigh
    ``weights`` in turn and share ``share`` times all sizes; a target stops at ``cap`` times its
    source's size, and the excess is shared again by weight until none is above.

    One row per source goes through one task, never a document. Filling the sources in order of
    ``cap * size / weight`` gives the end state of the repeated sharing in one pass.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1)
    everything = W.partitionBy()
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", F.col("rest") / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("level")))
    return filled.select("source", "source_size", target.alias("target"))


def rates(goals: DataFrame, atoms: DataFrame | None = None, cap: float | None = None, steps: int = NEWTON_STEPS) -> DataFrame:
    """Rates that balance the sources, by Newton's method on the dual of

        minimise sum of n * (r * log r - r)   given   sum of n * size * r = target,  r <= cap

    for each source. ``atoms`` are its documents, ``n`` of each ``size``; the solution tilts them
    exponentially, ``r = min(cap, exp(lambda * size / mean size))`` with the multiplier of the
    source. Returns ``source, size, rate``. Without ``atoms`` each source is one and ``goals`` come
    back with ``rate``.

    A step adds up mass and curvature over all atoms, where they lie, and moves every open source
    by Newton's step for the logarithm of its mass, which is exact for a single atom; a step that
    leaves the bracket of earlier ones halves it. A target of 0 has rate 0, one at the cap of all
    words the cap.
    """
    alone = atoms is None
    if alone:
        atoms = goals.select("source", F.col("source_size").alias("size"), F.lit(1).cast("bigint").alias("n"))
    most = F.lit(float("inf") if cap is None else float(cap))
    means = atoms.where("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("unit"))
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state, _ = freeze(
        goals.select("source", "source_size", "target").join(means.withColumnRenamed("source", "_m"), _same("source", "_m"), "left").select(
            "source", "target", "unit", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
            F.when(F.col("unit").isNull() | (F.col("target") <= 0), 0.0).when(full, most).alias("fixed"),
            (F.col("unit").isNull() | (F.col("target") <= 0) | full).alias("done"),
        )
    )

    def tilted(size: str) -> Column:
        # Beyond this exponent every rate is at a cap, and a double at its end.
        return F.exp(F.least(F.col("tilt") * F.col(size) / F.col("unit"), F.lit(700.0)))

    for _ in range(steps):
        open_ = state.where("not done").select(F.col("source").alias("_s"), "tilt", "unit")
        at = atoms.where("size > 0").join(open_, _same("source", "_s")).withColumn("r", tilted("size"))
        words = F.col("n") * F.col("size")
        sums = at.groupBy("_s").agg(
            F.sum(words * F.least("r", most)).alias("mass"),
            F.coalesce(F.sum(F.when(F.col("r") < most, words * F.col("size") / F.col("unit") * F.col("r"))), F.lit(0.0)).alias("curve"),
        )
        under = F.col("mass") < F.col("target")
        low, high = F.when(under, F.col("tilt")).otherwise(F.col("low")), F.when(under, F.col("high")).otherwise(F.col("tilt"))
        newton = F.col("tilt") + F.try_divide(F.ln(F.col("target") / F.col("mass")) * F.col("mass"), F.col("curve"))
        inside = newton.isNotNull() & ~F.isnan(newton) & (F.coalesce(newton > F.col("_low"), F.lit(True))) & F.coalesce(newton < F.col("_high"), F.lit(True))
        half = F.coalesce((F.col("_low") + F.col("_high")) / 2, F.col("_low") + 1, F.col("_high") - 1)
        near = F.abs(F.col("mass") - F.col("target")) <= 1e-10 * F.col("target")
        state, _ = freeze(
            state.join(sums, _same("source", "_s"), "left").withColumns({"_low": low, "_high": high}).select(
                "source", "target", "unit", F.when(F.col("done") | near, F.col("tilt")).when(inside, newton).otherwise(half).alias("tilt"),
                F.when(F.col("done"), F.col("low")).otherwise(F.col("_low")).alias("low"),
                F.when(F.col("done"), F.col("high")).otherwise(F.col("_high")).alias("high"),
                "fixed", (F.col("done") | F.coalesce(near, F.lit(False))).alias("done"),
            )
        )
        if not state.where("not done").limit(1).count():
            break
    solved = state.select(F.col("source").alias("_s"), "tilt", "unit", "fixed")
    rate = F.coalesce("fixed", F.least(tilted("size"), most)).alias("rate")
    found = atoms.join(solved, _same("source", "_s")).select("source", "size", rate)
    if alone:
        return goals.join(found.select(F.col("source").alias("_s"), "rate"), _same("source", "_s")).drop("_s")
    return found


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _prefix(open_: DataFrame) -> tuple[DataFrame, int]:
    """Per source of ``open_`` (blocks with the ``room`` of their source): ``most`` = the room,
    ``cut``, the hash before which its blocks stay within the room together, and their words
    ``reached``. Found from sums per (source, hash bin), then by the rows of the bin it lies in.
    """
    running = W.partitionBy("source").orderBy("bin")
    sums = open_.groupBy("source", "bin").agg(F.sum("words").alias("words"), F.max("room").alias("room"))
    until = F.col("until")
    ends = (
        sums.withColumn("until", F.sum("words").over(running))
        .groupBy("source")
        .agg(
            F.max("room").alias("most"), F.max(until).alias("total"),
            F.min(F.when(until > F.col("room"), F.struct("bin", (until - F.col("words")).alias("under")))).alias("c"),
        )
        .select(F.col("source").alias("_s"), "most", "total", F.col("c.bin").alias("cut_bin"), F.col("c.under").alias("under"))
    )
    ends, found = freeze(ends)
    if not found:
        return ends, 0
    passed = (
        open_.join(ends, _same("source", "_s") & (F.col("bin") == F.col("cut_bin")))
        .select("source", "u", "words", "under", "most")
        .withColumn("until", F.col("under") + F.sum("words").over(W.partitionBy("source").orderBy("u")))
        .where(until > F.col("most"))
        .groupBy("source")
        .agg(F.min(F.struct("u", (until - F.col("words")).alias("under"))).alias("c"))
        .select(F.col("source").alias("_p"), F.col("c.u").alias("cut"), F.col("c.under").alias("reached"))
    )
    # Without a block that passes the room, all are before the cut.
    return ends.join(passed, _same("_s", "_p"), "left").select(
        "_s", "most", F.coalesce("cut", F.lit(1 << HASH_BITS)).alias("cut"), F.coalesce("reached", "total").alias("reached")
    ), found


def _within(passes: str) -> Column:
    """Whether a block lies in one of the passes made over its source."""
    return F.exists(passes, lambda p: (F.col("words") <= p["most"]) & (F.col("u") < p["cut"]))


def _fill(blocks: DataFrame, state: DataFrame, room: str, passes: str, where: Column) -> DataFrame:
    """``state`` after passes in hash order over the blocks of each source that ``where`` allows
    and the room still holds, until it holds none of them: ``room`` falls, ``passes`` grows."""
    names = [c for c in state.columns if c != "source"]
    while True:
        on = blocks.join(state.select(F.col("source").alias("_s"), *names), _same("source", "_s"))
        fits = on.where((F.col("words") > 0) & (F.col("words") <= F.col(room)) & where & ~_within(passes))
        more, found = _prefix(fits.select("source", "u", "bin", "words", F.col(room).alias("room")))
        if not found:
            return state
        state, _ = freeze(
            state.join(more, _same("source", "_s"), "left")
            .withColumn(room, F.col(room) - F.coalesce("reached", F.lit(0)))
            .withColumn(passes, F.array_compact(F.array_append(passes, F.when(F.col("cut").isNotNull(), F.struct("most", "cut")))))
            .select("source", *names)
        )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    id_column: str = "doc_id",
) -> DataFrame:
    """How often every document goes into the mix.

    ``docs`` has ``source``, ``text`` and the id; other columns are not read. Returns, one row per
    input row: the id, ``source, size`` (words; null: 0), ``source_size, target`` (of its source),
    ``rate, copies`` (0 to ``cap``) and ``taken`` = ``copies * size``. A null source is a source of
    its own, the last one. Ids may be null or repeat; rows equal in id, source and size get the
    same copies. Documents of size 0 may get copies but take no words. Empty tables give no rows.
    Reruns agree, since all that is random is a hash of the row.

    Rates come from ``rates``: a document's is tilted by its size. Rounding keeps each source's sum:
    every document gets ``floor(rate)`` copies, and one more goes to those whose hash is below, or
    least above, the fraction that is left. One that is larger than what is left of the gap is
    left out, and the pass is made again over the others, until no free document fits. Where a gap
    is left, the smallest free document is tried too: it goes in, and others with one more go out
    by the same passes until none fits the excess; this stands where it ends nearer. So a source
    ends within half its smallest free document of its target, mostly much nearer; the best of
    all choices is not searched for. A pass finds its place from sums per (source, hash bin), then
    by the rows of one bin, a ``BINS``-th of the source. Nothing is ordered or collected per
    source: a source may hold any part of the rows.
    """
    low = F.lit((1 << HASH_BITS) - 1)
    hashed, _ = freeze(
        docs.select(F.col(id_column).alias("_id"), F.col("source"), size_of(F.col("text")).alias("size"))
        .withColumn("hash", F.xxhash64("_id", "source", "size").bitwiseAND(low))
    )
    atoms, _ = freeze(hashed.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes, _ = freeze(atoms.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    goals, _ = freeze(targets(sizes, weights, share, cap))
    tilts, _ = freeze(rates(goals, atoms, cap).select(F.col("source").alias("_t"), F.col("size").alias("_n"), "rate"))
    # A rate of 1.9999999 for a target at the cap must not leave out the last word.
    near = F.round("rate", 9)
    floor = F.least(F.floor(near), F.lit(cap)).cast("int")
    # One more copy is due where the hash is below the fraction that is left, so this is the order.
    due = (F.col("hash") / float(1 << HASH_BITS) - (near - floor) + 1) / 2 * float(1 << (HASH_BITS - 10))
    place = F.least(due.cast("bigint"), F.lit((1 << (HASH_BITS - 10)) - 1)) * 1024 + F.col("hash") % 1024
    sized, _ = freeze(
        hashed.join(tilts, _same("source", "_t") & (F.col("size") == F.col("_n"))).select(
            "_id", "source", "size", "rate", floor.alias("floor"), place.alias("u")
        )
    )
    # Rows that can't be told apart count as one block.
    blocks, _ = freeze(
        sized.groupBy("source", "u", "size", "floor")
        .agg((F.col("size") * F.count(F.lit(1))).alias("words"))
        .withColumn("bin", F.shiftright("u", HASH_BITS - BINS.bit_length() + 1))
    )
    none = F.array().cast("array<struct<most: double, cut: bigint>>")
    given = blocks.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("floor") * F.col("words")).alias("given"))
    state, _ = freeze(
        goals.join(given, _same("source", "_s"))
        .select("source", "source_size", "target", F.greatest(F.col("target") - F.col("given"), F.lit(0.0)).alias("gap"), none.alias("added"))
    )
    # Documents at the cap get no further copy.
    may = F.col("floor") < cap
    state = _fill(blocks, state, "gap", "added", may)
    free = blocks.join(state.select(F.col("source").alias("_s"), "gap", "added"), _same("source", "_s")).where(
        (F.col("gap") > 0) & (F.col("words") > 0) & may & ~_within("added")
    )
    over = free.groupBy("source").agg(F.min(F.struct("words", "u")).alias("extra")).select(F.col("source").alias("_s"), "extra")
    state, _ = freeze(
        state.join(over, _same("source", "_s"), "left")
        .drop("_s")
        .withColumn("excess", F.coalesce(F.col("extra.words") - F.col("gap"), F.lit(0.0)))
        .withColumn("dropped", none)
    )
    state = _fill(blocks, state, "excess", "dropped", may & _within("added"))
    # As it was before the extra document, where that is as near.
    swap = F.col("extra").isNotNull() & (F.col("excess") < F.col("gap"))
    state = state.withColumn("extra", F.when(swap, F.col("extra.u"))).withColumn("dropped", F.when(swap, F.col("dropped")).otherwise(none))
    state, _ = freeze(state)
    more = (_within("added") & ~_within("dropped")) | F.col("u").eqNullSafe(F.col("extra"))
    copies = (F.col("floor") + F.when(more & may, 1).otherwise(0)).cast("int")
    # Only blocks of several rows have other words than each of their rows.
    several = blocks.where("words > size").select(F.col("source").alias("_b"), F.col("u").alias("_u"), F.col("size").alias("_n"), "words")
    return (
        sized.join(several, _same("source", "_b") & (F.col("u") == F.col("_u")) & (F.col("size") == F.col("_n")), "left")
        .withColumn("words", F.coalesce("words", "size"))
        .join(state.withColumnRenamed("source", "_s"), _same("source", "_s"))
        .withColumn("copies", copies)
        .select(
            F.col("_id").alias(id_column), "source", "size", "source_size", "target", "rate", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """``docs`` with all its columns, every row as often as ``mix`` takes it. Null ids, sources and texts
    are values like others, repeated rows are taken alike, extra columns come along whatever their
    names; an empty table stays empty."""
    copies = mix(docs, id_column=id_column, **options).select(
        F.col(id_column).alias("_of"), F.col("source").alias("_from"), F.col("size").alias("_size"), "copies"
    ).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_column).alias("_id"), F.col("source").alias("_s"), size_of(F.col("text")).alias("_n"))
    same = _same("_id", "_of") & _same("_s", "_from") & (F.col("_n") == F.col("_size"))
    return (
        rows.join(copies, same)
        .where("copies > 0")
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
        .select("_row.*")
    )
