"""How far the word use of sources lies apart, and by which terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapsewise.llm.arrays import pieces
from lapsewise.session import freeze

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
#: Distinct terms of all groups that a task counts before it sends them on.
HELD_TERMS = 300_000
#: (source, term) rows of a block of terms, all languages together.
BLOCK_ROWS = 200_000
#: Sources of one side of a pair task.
TILE = 64
#: Ids of the shorter list that one galloping search places at once.
STRIDE = 1_024

# Everything but letters of any script becomes a space; A-Z become small.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)
)


def scaled(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact for totals below 9 * 10 ** 15: the
    division is done in three steps of a thousand each."""
    rest, whole = counts.astype(np.int64) + 1, np.zeros(counts.shape, np.int64)
    for _ in range(3):
        rest = rest * 1_000
        whole = whole * 1_000 + rest // (total + kept)
        rest %= total + kept
    return whole + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``short`` and ``long`` (sorted, without repeats) of the ids that both hold. For each
    stride of the short list the search doubles its step from where the last stride ended until it
    has passed the stride's last id, and looks for the ids in between only."""
    found, at = [], 0
    for begin in range(0, short.size, STRIDE):
        ids = short[begin : begin + STRIDE]
        step = ids.size
        while at + step < long.size and long[at + step] < ids[-1]:
            step *= 2
        places = at + np.searchsorted(long[at : at + step + 1], ids)
        found.append(places)
        at = int(places[-1])
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    both = places < long.size
    both[both] = long[places[both]] == short[both]
    return np.flatnonzero(both), places[both]


class Side:
    """One source's terms of a block, with their scaled shares."""

    def __init__(self, source: str, ids: np.ndarray, counts: np.ndarray, total: int, kept: int):
        self.source, self.ids = source, ids
        self.p = scaled(counts, total, kept)
        self.absent = scaled(np.zeros(1, np.int64), total, kept)


def merge(a: Side, b: Side, terms: int) -> tuple[int, int]:
    """Value of ``a`` against ``b`` and of ``b`` against ``a`` over a block of ``terms`` terms:
    terms of both, of one only, and of neither."""
    if a.ids.size > b.ids.size:
        return merge(b, a, terms)[::-1]
    in_a, in_b = gallop(a.ids, b.ids)
    only_a, only_b = np.ones(a.ids.size, bool), np.ones(b.ids.size, bool)
    only_a[in_a], only_b[in_b] = False, False
    both_a, both_b, pa_, pb = a.p[in_a], b.p[in_b], a.p[only_a], b.p[only_b]
    neither = terms - a.ids.size - b.ids.size + in_a.size
    there = price(both_a, both_b).sum() + price(pa_, b.absent).sum() + price(a.absent, pb).sum()
    back = price(both_b, both_a).sum() + price(pb, a.absent).sum() + price(b.absent, pa_).sum()
    return (
        int(there + neither * price(a.absent, b.absent)[0]), int(back + neither * price(b.absent, a.absent)[0])
    )


def _counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: how often each source has a term and in how many rows, and
    one row with a null term for each group.

    A task adds up what it sees of up to ``HELD_TERMS`` terms, so what it sends on grows with the
    text at most, and a frequent term is one row of a task.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])

    def drain(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, seen) in held.items():
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            counts = pa.array([0, *n.values()], pa.int64())
            within = pa.array([0, *map(seen.__getitem__, n)], pa.int64())
            names = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int32))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, terms, counts, within], ["lang", "source", "term", "n", "docs"])
        held.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                groups = zip(part.column("lang").to_pylist(), part.column("source").to_pylist())
                for text, group in zip(texts, groups):
                    words = text.translate(_LETTERS).split()
                    if group not in held:
                        held[group] = Counter(), Counter()
                    n, seen = held[group]
                    n.update(words)
                    seen.update(set(words))
                if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                    yield from drain(held)
        yield from drain(held)

    counted = rows.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _arrays(blocked: DataFrame, least: int) -> DataFrame:
    """``lang, block, source, kept, total, ids, n, lang_n, terms``: for each source its kept terms of
    a block, sorted, and how often the source and its language have them. The ids number a block's
    kept terms. The row with a null source stands for the block itself."""

    def sorted_lists(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sides = sorted(set(table.column("source").to_pylist()))
        rows = table.filter(pc.is_valid(table.column("term")))
        coded = rows.column("term").combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        n, docs = (rows.column(c).to_numpy() for c in ("n", "docs"))
        within = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(within, code, docs)
        order = pc.sort_indices(coded.dictionary).to_numpy()  # by the bytes of UTF-8
        order = order[within[order] >= least]
        number = np.full(within.size, -1, np.int64)
        number[order] = np.arange(order.size)
        ids = number[code]
        whole = np.zeros(order.size, np.int64)
        np.add.at(whole, ids[ids >= 0], n[ids >= 0])
        side = pc.index_in(rows.column("source").combine_chunks(), pa.array(sides, pa.string())).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(ids >= 0)
        kept = kept[np.lexsort((ids[kept], side[kept]))]
        ends = np.searchsorted(side[kept], np.arange(len(sides) + 1)).astype(np.int32)
        # The block's own row is first and has no terms.
        ends = pa.array(np.append(np.int32(0), ends), pa.int32())
        totals = np.append(0, np.cumsum(n[kept]))[ends.to_numpy()]
        ids = ids[kept]
        columns = {
            "lang": pa.array([key[0].as_py()] * (len(sides) + 1), pa.string()),
            "block": pa.array([key[1].as_py()] * (len(sides) + 1), pa.int64()),
            "source": pa.array([None, *sides], pa.string()),
            "kept": pa.array([order.size] * (len(sides) + 1), pa.int64()),
            "total": pa.array([int(whole.sum()), *np.diff(totals)[1:].tolist()], pa.int64()),
            "ids": pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
            "n": pa.ListArray.from_arrays(ends, pa.array(n[kept], pa.int64())),
            "lang_n": pa.ListArray.from_arrays(ends, pa.array(whole[ids], pa.int64())),
            "terms": pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(order[ids]))),
        }
        return pa.table(columns)

    schema = (
        "lang string, block bigint, source string, kept bigint, total bigint, ids array<int>, n array<bigint>, "
        "lang_n array<bigint>, terms array<string>"
    )
    return blocked.groupBy("lang", "block").applyInArrow(sorted_lists, schema)


def _tops(arrays: DataFrame, top: int) -> DataFrame:
    """The best ``top`` terms of each block and group by value, then term."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in batch.schema.names}
                if not len(one["n"]):
                    continue
                n, lang_n = one["n"].values.to_numpy(), one["lang_n"].values.to_numpy()
                kept = one["lang_kept"].as_py()
                p = scaled(n, one["group_total"].as_py(), kept)
                q = scaled(lang_n, one["lang_total"].as_py(), kept)
                value = np.where(p > q, price(p, q), -1)
                # Terms are sorted, so a stable sort leaves ties in their order.
                order = np.argsort(-value, kind="stable")[:top]
                order = order[value[order] >= 0]
                order = order[(p > q)[order]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([one["lang"].as_py()] * order.size, pa.string()),
                        pa.array([one["source"].as_py()] * order.size, pa.string()),
                        one["terms"].values.take(pa.array(order)).cast(pa.string()), pa.array(value[order]),
                    ],
                    ["lang", "source", "item", "value"],
                )

    wanted = arrays.select("lang", "source", "n", "lang_n", "terms", "group_total", "lang_total", "lang_kept")
    return wanted.mapInArrow(best, "lang string, source string, item string, value bigint")


def _pairs(arrays: DataFrame) -> DataFrame:
    """``lang, source, item, value``: what the pair tasks of each block add up for every ordered pair.

    A task co-groups the sorted arrays of two tiles of sources (a tile with itself, too) in one
    block and merges each unordered pair once, for both directions.
    """
    rows = arrays.select("lang", "block", "source", "kept", "ids", "n", "group_total", "lang_kept", "tile", "tiles")
    left = rows.select("*", F.col("tile").alias("a"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("b"))
    # Columns of their own, as both sides come from one table.
    again = rows.select([F.col(c).alias(c) for c in rows.columns])
    right = again.where("tile > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("tile") - 1)).alias("a"), F.col("tile").alias("b"))

    def sides(table: pa.Table) -> list[tuple[Side, int]]:
        out = []
        for row in range(table.num_rows):
            one = {c: table.column(c)[row] for c in ("source", "kept", "ids", "n", "group_total", "lang_kept")}
            ids, n = one["ids"].values.to_numpy(), one["n"].values.to_numpy()
            side = Side(one["source"].as_py(), ids, n, one["group_total"].as_py(), one["lang_kept"].as_py())
            out.append((side, one["kept"].as_py()))
        return out

    def task(key, first: pa.Table, second: pa.Table) -> pa.Table:
        mine, others = sides(first), sides(second)
        inside = key[2].as_py() == key[3].as_py()
        found = []
        for k, (x, terms) in enumerate(mine):
            for y, _ in mine[k + 1 :] if inside else others:
                there, back = merge(x, y, terms)
                found += [(x.source, y.source, there), (y.source, x.source, back)]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()] * len(found), pa.string()), "source": pa.array(columns[0], pa.string()),
                "item": pa.array(columns[1], pa.string()), "value": pa.array(columns[2], pa.int64()),
            }
        )

    key = ("lang", "block", "a", "b")
    priced = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        task, "lang string, source string, item string, value bigint"
    )
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """How each source's use of words differs from the other sources' and from the language's.

    Reads ``text``, ``lang`` and ``source`` of ``docs`` (null: empty string). Terms are runs of
    ASCII letters and of characters beyond ASCII, A-Z made small. A language keeps the terms that
    stand in at least ``least`` of its rows. Returns ``lang, source, part, item, value, rank``: part
    ``pair`` with every other source of the language as item, part ``term`` with the ``top`` terms
    that the source uses more than the language does. All numbers are exact integers. A group
    without terms is compared as well; a language without kept terms has values of 0. Rows count
    one by one, repeated ones too; an empty table gives no rows; other columns are not read.

    Terms are spread over blocks by their number, so no task sees a whole vocabulary or a whole
    group.
    """
    counted, rows = freeze(_counted(docs))
    blocks = 1 + rows // BLOCK_ROWS
    place = F.crc32(F.col("term").cast("binary")) % blocks
    # Every source stands in every block of its language, with or without terms there.
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    blocked = counted.where("term is not null").withColumn("block", place).unionByName(
        counted.where("term is null").withColumn("block", everywhere)
    )
    arrays, _ = freeze(_arrays(blocked, least))
    languages = arrays.where("source is null").groupBy(F.col("lang").alias("_lang")).agg(
        F.sum("total").alias("lang_total"), F.sum("kept").alias("lang_kept")
    )
    totals = arrays.where("source is not null").groupBy("lang", "source").agg(F.sum("total").alias("group_total"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    numbered = totals.withColumn("tile", F.floor(place / TILE).cast("int"))
    last = numbered.groupBy(F.col("lang").alias("_l")).agg((F.max("tile") + 1).alias("tiles"))
    known, _ = freeze(
        numbered.join(languages, F.col("lang") == F.col("_lang")).join(last, F.col("lang") == F.col("_l"))
        .select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "group_total", "lang_total", "lang_kept", "tile", "tiles")
    )
    placed = arrays.where("source is not null").join(
        known, (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source"))
    ).drop("_lang", "_source")
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(placed).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    terms = _tops(placed, top).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.union(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
