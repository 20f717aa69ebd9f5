"""Interaction of filters: who removes what in which order, from survivors of all filter subsets."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.arrays import pieces
from lapsewise.session import freeze

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
#: Label classes a document can be in: bit 0 good, bit 1 toxic.
CLASSES = 4
#: Parts whose counts a task holds before it sends them on.
HELD_GROUPS = 8_192

_CAPITAL, _START, _SYMBOL = np.zeros((3, 256), bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_START[:] = (np.arange(256) & 0xC0) != 0x80
_SYMBOL[list(b"#$%&*|")] = True

#: For every set of failed filters the word of surviving subsets: bit S is set where the document
#: passes all filters of subset S.
SURVIVAL = np.array(
    [sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32
)


def text_failures(texts: pa.Array) -> np.ndarray:
    """Failed filters A to D of whole texts, as bits 0 to 3; a null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2] if buffers[2] is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]

    def per_text(table: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(table[data])
        return np.diff(np.searchsorted(at, bounds))

    capitals, points, symbols = per_text(_CAPITAL), per_text(_START), per_text(_SYMBOL)
    words = [x.split() for x in texts.to_pylist()]  # bytes split at ASCII white space only
    total = np.fromiter(map(len, words), np.int64, n)
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, n)
    failed = (total < LEAST_WORDS).astype(np.int32)
    failed |= (100 * distinct < LEAST_DISTINCT * total).astype(np.int32) << 1
    failed |= (100 * capitals > MOST_CAPITALS * points).astype(np.int32) << 2
    return failed | (symbols > 0).astype(np.int32) << 3


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set, by carry-save addition: three words of
    one weight become a sum of that weight and a carry of twice the weight, column by column."""
    counts = np.zeros(32, np.int64)
    bits = np.arange(32, dtype=np.uint32)
    weight = 1
    while words.size:
        carries = []
        while words.size > 2:
            third = words.size // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append(a & b | half & c)
            words = np.concatenate([half ^ c, words[3 * third :]])
        counts += weight * ((words[:, None] >> bits) & 1).sum(0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def failures(docs: DataFrame, id_column: str = "doc_id", part_column: str = "source") -> DataFrame:
    """``id, part, failed, copies``: the filters (bits 0 to 4 for A to E) that rows of ``docs`` fail.

    E is failed by a document whose text stands under a smaller id anywhere in the table; a null id
    is not smaller and has none smaller. Rows that agree in id, part and text are one row with
    their number in ``copies``. Texts are compared by their SHA-256.
    """
    name = docs.schema[id_column].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                texts = pc.fill_null(part.column("text"), "").cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("part"), pa.array(text_failures(part.column("text"))),
                        pa.array([hashlib.sha256(x).digest() for x in texts.to_pylist()], pa.binary()),
                    ],
                    ["id", "part", "failed", "digest"],
                )

    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text")
    )
    judged, _ = freeze(rows.mapInArrow(judge, f"id {name}, part string, failed int, digest binary"))
    # Both sides collapse in the tasks that read them, so a text or row that fills a third of the
    # table is a few rows a task; the join is on (text, id), which no group shares.
    merged = judged.groupBy("digest", "id", "part", "failed").agg(F.count(F.lit(1)).alias("copies"))
    firsts = judged.groupBy(F.col("digest").alias("_digest")).agg(F.min("id").alias("_first")).where("_first is not null")
    joined = merged.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("id") == F.col("_first")), "left")
    later = F.col("id").isNotNull() & F.col("_first").isNull()
    return joined.select("id", "part", F.col("failed").bitwiseOR(F.when(later, 16).otherwise(0)).alias("failed"), "copies")


def survivors(rows: DataFrame) -> DataFrame:
    """From ``part, failed, class, copies``: ``part, class, subset, n``, the documents that pass
    every filter of each subset. A task keeps one row of 32 counts for each part and class."""

    def count(batches):
        held: dict[tuple, np.ndarray] = {}

        def drain():
            for (part, kind), counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * SUBSETS, pa.string()), pa.array([kind] * SUBSETS, pa.int32()),
                        pa.array(range(SUBSETS), pa.int32()), pa.array(counts),
                    ],
                    ["part", "class", "subset", "n"],
                )
            held.clear()

        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            names = coded.dictionary.to_pylist()
            key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * CLASSES + batch.column("class").to_numpy()
            copies = batch.column("copies").to_numpy()
            words = SURVIVAL[batch.column("failed").to_numpy()]
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1))
            for a, b in zip(cuts, cuts[1:]):
                at = order[a:b]
                counts = positional_counts(words[at])
                for more in at[copies[at] > 1]:  # merged rows count as often as they stood there
                    counts += (copies[more] - 1) * ((words[more] >> np.arange(32, dtype=np.uint32)) & 1).astype(np.int64)
                group = (names[key[order[a]] // CLASSES], int(key[order[a]] % CLASSES))
                held[group] = held.get(group, 0) + counts
            if len(held) > HELD_GROUPS:
                yield from drain()
        yield from drain()

    counted = rows.select("part", "failed", "class", "copies").mapInArrow(count, "part string, class int, subset int, n bigint")
    return counted.groupBy("part", "class", "subset").agg(F.sum("n").alias("n"))


def interactions(survived: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, for each part: what is kept and removed.

    A count of a step is a difference of survivors: ``removed`` of the filters before it and those
    with it, ``redundant`` what the filter fails alone less that, ``unique_fails`` the survivors
    of all others less those of all. ``shapley`` adds up a filter's ``removed`` over all orders.
    """
    every = SUBSETS - 1

    def array_of(value: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("subset") == s, value)), F.lit(0)).alias(str(s)) for s in range(SUBSETS)])

    n, kind = F.col("n"), F.col("class")
    arrays = survived.groupBy("part").agg(
        array_of(n).alias("_all"), array_of(F.when(kind.bitwiseAND(1) > 0, n)).alias("_good"),
        array_of(F.when(kind.bitwiseAND(2) > 0, n)).alias("_toxic"),
    )
    steps = [
        {"o": "".join(FILTERS[k] for k in order), "s": step + 1, "k": one, "b": sum(1 << k for k in order[:step])}
        for order in permutations(range(len(FILTERS)))
        for step, one in enumerate(order)
    ]

    def at(counts: str, subset) -> Column:
        return F.get(F.col(counts), subset)

    def over_orders(one: int) -> Column:
        times = Counter(x["b"] for x in steps if x["k"] == one)
        return sum(
            (n * (at("_all", F.lit(b)) - at("_all", F.lit(b | 1 << one))) for b, n in sorted(times.items())), start=F.lit(0)
        )

    shapley = F.array(*[over_orders(k) for k in range(len(FILTERS))])
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<o string, s int, k int, b int>>")
    each = arrays.select("part", "_all", "_good", "_toxic", shapley.alias("_shapley"), F.explode(table).alias("_x"))
    rows = each.select(
        "*", F.col("_x.o").alias("filter_order"), F.col("_x.s").alias("step"), F.col("_x.k").alias("_k"),
        F.col("_x.b").alias("_before"), F.pow(F.lit(2), F.col("_x.k")).cast("int").alias("_bit"),
    ).withColumn("_after", F.col("_before") + F.col("_bit"))

    def lost(counts: str) -> Column:
        return at(counts, F.col("_before")) - at(counts, F.col("_after"))

    fails = at("_all", F.lit(0)) - at("_all", F.col("_bit"))
    return rows.select(
        "part", "filter_order", "step", at("_all", F.col("_after")).alias("kept"), lost("_all").alias("removed"),
        (fails - lost("_all")).alias("redundant"),
        (at("_all", F.lit(every) - F.col("_bit")) - at("_all", F.lit(every))).alias("unique_fails"),
        lost("_good").alias("good_lost"), lost("_toxic").alias("toxic_lost"), F.get("_shapley", F.col("_k")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", part_column: str = "source") -> DataFrame:
    """How five filters act together on ``docs`` (id, ``text``, part; other columns are not read).

    A: under 200 words; B: fewer than half of them distinct; C: over 2 % capitals among the code
    points; D: one of ``#$%&*|``; E: the text of a smaller id. One row per part (null: empty
    string), order of the filters and step, with the counts of ``interactions``. A null text is
    empty. Rows count one by one, repeated ones too. A document is good or toxic if any row of
    ``labels`` (``doc_id, quality, toxic``) with its id says so; a null id has no labels. An empty
    table gives no rows.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"),
        F.max(F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("_toxic"),
    )
    judged = failures(docs, id_column, part_column)
    # Rows without an id would all meet in one task of the join.
    marked = judged.where("id is not null").join(marks, F.col("id") == F.col("_doc"), "left").select(
        "part", "failed", "copies", (F.coalesce("_good", F.lit(0)) + F.coalesce("_toxic", F.lit(0))).alias("class")
    )
    unmarked = judged.where("id is null").select("part", "failed", "copies", F.lit(0).alias("class"))
    return interactions(survivors(marked.union(unmarked)))
