"""Exact top-k by inner product with one KD-tree per shard."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapsewise.session import freeze

LEAF = 64
#: Vectors of a shard and queries of a block, about: what one task holds at a time.
SHARD_ROWS = 4_096
BLOCK_ROWS = 4_096
#: Beyond this, products are added up as whole numbers, since doubles would lose digits.
EXACT = float(1 << 53)


def _matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros."""
    lists = vectors.cast(pa.large_list(pa.int64()))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], int)
    width = max(width or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(sizes.size), sizes), np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Tree:
    """Median splits of the widest dimension down to leaves, with the tight box of every node.

    Node k has the children 2k + 1 and 2k + 2 and covers ``rows[begin[k]:end[k]]``.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(ids.size)
        depth = max(0, int(np.ceil(np.log2(max(1, ids.size) / LEAF))))
        nodes = (1 << (depth + 1)) - 1
        self.begin, self.end = np.zeros(nodes, int), np.zeros(nodes, int)
        self.low = np.zeros((nodes, points.shape[1]), np.int64)
        self.high = np.zeros((nodes, points.shape[1]), np.int64)
        self.end[0] = ids.size
        self.first_leaf = nodes // 2
        for k in range(nodes):
            a, b = self.begin[k], self.end[k]
            if a < b:
                mine = points[order[a:b]]
                self.low[k], self.high[k] = mine.min(0), mine.max(0)
                if k < self.first_leaf:
                    wide = int((self.high[k] - self.low[k]).argmax()) if points.shape[1] else 0
                    middle = (b - a) // 2
                    if points.shape[1]:
                        order[a:b] = order[a:b][np.argpartition(mine[:, wide], middle)]
            if k < self.first_leaf:
                cut = a + (b - a) // 2
                self.begin[2 * k + 1], self.end[2 * k + 1] = a, cut
                self.begin[2 * k + 2], self.end[2 * k + 2] = cut, b
        self.ids, self.points = ids[order], points[order]

    def dump(self) -> bytes:
        head = np.array([*self.points.shape, self.begin.size, self.first_leaf], np.int64)
        parts = (head, self.begin, self.end, self.low, self.high, self.ids, self.points)
        return b"".join(np.ascontiguousarray(x, np.int64).tobytes() for x in parts)

    @classmethod
    def load(cls, data: bytes) -> Tree:
        x, at = np.frombuffer(data, np.int64), 4
        n, width, nodes, first_leaf = (int(v) for v in x[:4])
        tree = cls.__new__(cls)
        tree.first_leaf = first_leaf

        def take(*shape: int) -> np.ndarray:
            nonlocal at
            size = int(np.prod(shape))
            at += size
            return x[at - size : at].reshape(shape)

        tree.begin, tree.end = take(nodes), take(nodes)
        tree.low, tree.high = take(nodes, width), take(nodes, width)
        tree.ids, tree.points = take(n), take(n, width)
        return tree


def _numbers(points: np.ndarray, queries: np.ndarray) -> type:
    """Doubles where every sum of products fits in 53 bits, else whole numbers of 64 bits."""
    top = float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, points.shape[1])
    return np.float64 if top < EXACT else np.int64


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
    """For each query the ``k`` best of the tree as (query, id, score), without what scores below
    ``floor``, the kth score some other shard has for the query. Ties go to the smaller id.

    The largest product of a query with a box takes each dimension's better corner. Nodes are
    visited best bound first; a query stops when the next bound is below its kth score.
    """
    width = max(tree.points.shape[1], queries.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    kind = _numbers(tree.points, queries)
    points, low, high = (pad(m).astype(kind) for m in (tree.points, tree.low, tree.high))
    asked = pad(queries).astype(kind)
    bounds = np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T
    out = []
    for q in range(query_ids.size):
        bound, least = bounds[q], int(floor[q])
        frontier = [(-bound[0], 0)]
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        while frontier and -frontier[0][0] >= least:
            _, node = heapq.heappop(frontier)
            if node < tree.first_leaf:
                for child in (2 * node + 1, 2 * node + 2):
                    if tree.begin[child] < tree.end[child] and bound[child] >= least:
                        heapq.heappush(frontier, (-bound[child], child))
                continue
            a, b = tree.begin[node], tree.end[node]
            scores = points[a:b] @ asked[q]
            for at in np.flatnonzero((scores >= least) & (tree.ids[a:b] != query_ids[q])):
                entry = (int(scores[at]), -int(tree.ids[a + at]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                least = max(least, best[0][0])
        out += [(q, -i, s) for s, i in best]
    return out


_LOWEST = -(1 << 63)
FOUND = "query_id bigint, vec_id bigint, score bigint"


def _search_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """``pairs``: one row for a shard's tree and a block of queries with their floors."""

    def run(_, table):
        tree, ids, vectors, floors = (table.column(c).combine_chunks() for c in ("tree", "ids", "vectors", "floors"))
        names = ids.flatten().to_numpy(zero_copy_only=False)
        found = search(
            Tree.load(tree[0].as_py()), names, _matrix(vectors.flatten()), floors.flatten().to_numpy(zero_copy_only=False), k
        )
        return pa.table(
            {
                "query_id": pa.array([names[q] for q, _, _ in found], pa.int64()),
                "vec_id": pa.array([i for _, i, _ in found], pa.int64()),
                "score": pa.array([s for _, _, s in found], pa.int64()),
            }
        )

    # A group is a single row, so a task holds one tree and one block at a time.
    return pairs.select("shard", "block", "tree", "ids", "vectors", "floors").groupBy("shard", "block").applyInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``k`` largest inner products of every query with the other rows of ``vectors``.

    Both tables have ``vec_id`` and ``vector``, an array of whole numbers (``quantized`` makes
    it); other columns are not read. Returns ``query_id, rank`` (from 1)``, vec_id, score``; all
    candidates if there are fewer than ``k``, no row for a query without any. Ties go to the
    smaller id. A query never meets rows of its own id. Repeated rows count one by one: as candidates
    each is a row of the result, and an id with several query rows gets the best of what all of them
    find. Rows with a null id or a null vector take no part; of vectors of different lengths the
    shorter one ends in zeros. Scores beyond 64 bits wrap around, as ``bigint`` does.

    Vectors are dealt to shards by a hash of id and place, so that no id fills one, and each shard becomes a tree, written once.
    Queries are dealt to blocks. First every block searches one shard, by which each query gets a
    kth score; then the block searches the other shards, where a query visits only boxes that can
    reach that score. The kth scores travel with the queries, so no search waits for another.
    """
    clean = vectors.where("vec_id is not null and vector is not null").select(
        F.col("vec_id").cast("bigint"), F.col("vector").cast("array<bigint>")
    )
    asked = queries.where("vec_id is not null and vector is not null").select(
        F.col("vec_id").cast("bigint"), F.col("vector").cast("array<bigint>")
    )
    shards = max(1, -(-clean.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_rows))
    pick = F.xxhash64("vec_id", F.monotonically_increasing_id())

    def build(key, rows):
        table = pa.Table.from_batches(rows) if not isinstance(rows, pa.Table) else rows
        points = _matrix(table.column("vector").combine_chunks())
        ids = table.column("vec_id").to_numpy()
        both = np.concatenate([ids[:, None], points], axis=1)
        both = both[np.lexsort(both.T[::-1])]  # whatever order the rows came in
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([Tree(both[:, 0], both[:, 1:]).dump()], pa.binary())})

    trees, _ = freeze(
        clean.withColumn("shard", F.pmod(pick, shards).cast("int")).groupBy("shard").applyInArrow(build, "shard int, tree binary")
    )

    def gather(key, table):
        rows = sorted(zip(table.column("vec_id").to_pylist(), table.column("vector").to_pylist()))
        return pa.table(
            {
                "block": pa.array([key[0].as_py()], pa.int32()),
                "ids": pa.array([[i for i, _ in rows]], pa.list_(pa.int64())),
                "vectors": pa.array([[v for _, v in rows]], pa.list_(pa.list_(pa.int64()))),
            }
        )

    batches, _ = freeze(
        asked.withColumn("block", F.pmod(F.shiftright(pick, 20), blocks).cast("int"))
        .groupBy("block")
        .applyInArrow(gather, "block int, ids array<bigint>, vectors array<array<bigint>>")
    )
    no_floor = F.array_repeat(F.lit(_LOWEST).cast("bigint"), F.size("ids"))
    pilot = batches.withColumn("shard", F.pmod("block", F.lit(shards)))
    first, _ = freeze(_best(_search_pairs(pilot.join(trees, "shard").withColumn("floors", no_floor), k), k))
    reached = first.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("_floor"))
    floors = (
        batches.select("block", F.posexplode("ids").alias("at", "id"))
        .join(reached, F.col("id") == F.col("_q"), "left")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("_floor", F.lit(_LOWEST)).cast("bigint").alias("f")))).alias("fs"))
        .select(F.col("block").alias("_b"), F.col("fs.f").alias("floors"))
    )
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.pmod(F.col("block"), F.lit(shards)))
    rest = (
        batches.join(floors, F.col("block") == F.col("_b"))
        .withColumn("shard", F.explode(others))
        .join(trees, "shard")
    )
    found = first.select("query_id", "vec_id", "score").unionByName(_search_pairs(rest, k))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def quantized(df: DataFrame, column: str, scale: int = 64) -> DataFrame:
    """``vec_id, vector``: floor(scale * x) of every component as a double. Vectors that are null
    or hold a null or non-finite component are left out."""
    x = F.col(column)
    finite = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != F.lit(float("inf")))
    )
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("bigint"))
    return df.where(x.isNotNull() & finite).select("vec_id", whole.alias("vector"))
