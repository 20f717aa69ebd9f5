"""N-gram Jaccard join by T-occurrence search."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.arrays import Words, give_back, mix, pieces, run_hashes
from lapsewise.llm.components import connected
from lapsewise.session import freeze

SHINGLE = 5
#: Similarity as a fraction of whole numbers: 75 / 100.
ABOVE, BELOW = 75, 100
#: Bytes of text worked on at once, which take some thirty times as much in arrays.
PIECE = 1 << 20
#: Texts of a block, which two bytes name.
BLOCK_TEXTS = 1 << 16
#: Candidates that one search looks at together.
CANDIDATES = 512
#: Weight of a probe against a heap step in the choice of long lists.
PROBE_WEIGHT = 0.0085


def needed(n: int) -> int:
    """Shingles a set of ``n`` shares at least with a partner."""
    return -(-ABOVE * n // BELOW)


def needed_overlap(n: int, m: int) -> int:
    """Smallest overlap of sets of ``n`` and ``m`` that makes them similar."""
    return -(-ABOVE * (n + m) // (ABOVE + BELOW))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text, one after the other, and where they
    begin. A text of fewer words than a shingle is one shingle of all its words."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    grams, first = words.gram_hashes(SHINGLE, hashes)
    counts = np.diff(first)
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    owner = np.repeat(np.arange(counts.size), counts)
    if short.size:
        whole = run_hashes(hashes, words.first[short], words.first[short + 1])
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(grams.size, bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[fresh], owner[fresh]
    return grams, np.searchsorted(owner, np.arange(counts.size + 1))


def digests(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes for every set, equal for equal sets."""
    sums = np.zeros((grams.size + 1, 2), np.uint64)
    np.cumsum(mix(grams ^ np.uint64(0x243F6A8885A308D3)), out=sums[1:, 0])
    np.cumsum(mix(grams + np.uint64(0x13198A2E03707344)), out=sums[1:, 1])
    out = sums[first[1:]] - sums[first[:-1]]
    out[:, 0] += np.diff(first).astype(np.uint64)
    return out


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: sorted hashes of a bucket then compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _unplaned(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


BLOCKS = "block bigint, bucket bigint, hashes binary, owners binary, ids binary, sizes binary, digests binary"


def _spare(sizes: np.ndarray) -> np.ndarray:
    """How many of its shingles a set may not share with a partner."""
    return sizes - -(-ABOVE * sizes // BELOW)


def _postings(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of documents by bucket of the hash: sorted shingle hashes with the text's number.

    A bucket of its own, below 0, has the block's ids with text keys, set sizes and digests.
    """

    def cut(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                for at in range(0, part.num_rows, BLOCK_TEXTS):
                    yield from one(part.slice(at, BLOCK_TEXTS), block)
                    block += 1
        give_back()

    def one(part, block):
        grams, first = shingle_sets(part.column("text"))
        sizes = np.diff(first)
        owner = np.repeat(np.arange(sizes.size), sizes)
        order = np.argsort(grams, kind="stable")
        hashes, posting = grams[order], owner[order].astype(np.uint16)
        width = np.uint64((1 << 64) // buckets)
        bucket = np.minimum(hashes // width, np.uint64(buckets - 1)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64()), ("key", pa.binary())])) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays([part.column("_id"), part.column("_key")], ["id", "key"]))
        out = [(block, -1 - block, None, None, sink.getvalue().to_pybytes(), sizes.astype(np.int64).tobytes(), digests(grams, first).tobytes())]
        out += [
            (block, k, _planes(hashes[a:b]), _planes(posting[a:b]), None, None, None)
            for k, (a, b) in enumerate(zip(edges, edges[1:]))
            if a < b
        ]
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
        names = ["block", "bucket", "hashes", "owners", "ids", "sizes", "digests"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return docs.mapInArrow(cut, BLOCKS)


MET = "block bigint, singles binary, shared binary, sharers binary, ranks binary, ids binary, sizes binary, digests binary"


def _meet(key, table):
    """One bucket of all blocks: per block the texts' hashes that stand alone, and the others with
    a rank by the number of texts that have them."""
    heads = ("ids", "sizes", "digests")
    names = ["block", "singles", "shared", "sharers", "ranks", *heads]
    if key[0].as_py() < 0:
        none = pa.nulls(table.num_rows, pa.binary())
        return pa.table([table.column("block"), none, none, none, none, *(table.column(c) for c in heads)], names)
    blocks = table.column("block").to_pylist()
    hashes = [_unplaned(x, np.uint64) for x in table.column("hashes").to_pylist()]
    owners = [_unplaned(x, np.uint16) for x in table.column("owners").to_pylist()]
    source = np.repeat(np.arange(len(blocks)), [x.size for x in hashes])
    every, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(every, kind="stable")
    every, owner, source = every[order], owner[order], source[order]
    start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    size = np.diff(np.append(start, every.size))
    having = np.repeat(size, size)
    rank = np.minimum(having, 255).astype(np.uint8)
    alone = having == 1
    out = {c: [] for c in names}
    order = np.argsort(source, kind="stable")
    cuts = np.searchsorted(source[order], np.arange(len(blocks) + 1))
    for k, block in enumerate(blocks):
        mine = order[cuts[k] : cuts[k + 1]]
        single, shared = mine[alone[mine]], mine[~alone[mine]]
        out["block"].append(block)
        out["singles"].append(_planes(owner[single]))
        out["shared"].append(_planes(every[shared]))
        out["sharers"].append(_planes(owner[shared]))
        out["ranks"].append(rank[shared].tobytes())
    for c in heads:
        out[c] = [None] * len(blocks)
    return pa.table([pa.array(c, pa.int64() if name == "block" else pa.binary()) for name, c in out.items()], names)


def _gather(key, table):
    """A block's texts with the shared hashes by which those that may have a partner meet it.

    By rank, then hash, the first hash a text shares with a partner is among as many as it may
    miss and one more. Hashes of one text alone come first (``skipped`` of them); a text with over
    a quarter of its set in them has no partner.
    """
    whole = table.column("sizes").is_valid()
    block, right = table.filter(whole).to_pylist()[0], table.filter(pc.invert(whole))
    names = pa.ipc.open_stream(block["ids"]).read_all().combine_chunks()
    sizes, digest = np.frombuffer(block["sizes"], np.int64), np.frombuffer(block["digests"], np.uint8).reshape(-1, 16)

    def join(column, kind):
        return np.concatenate([np.zeros(0, kind), *(_unplaned(x, kind) for x in right.column(column).to_pylist())])

    singles = np.bincount(join("singles", np.uint16), minlength=sizes.size)
    shared, sharers, ranks = join("shared", np.uint64), join("sharers", np.uint16).astype(np.int64), join("ranks", np.uint8)
    room = np.maximum(_spare(sizes) + 1 - singles, 0)
    order = np.lexsort((shared, ranks, sharers))
    shared, sharers = shared[order], sharers[order]
    counts = np.bincount(sharers, minlength=sizes.size)
    place = np.arange(shared.size) - np.repeat(np.cumsum(counts) - counts, counts)
    keep = place < room[sharers]
    counts = np.bincount(sharers[keep], minlength=sizes.size)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(shared[keep].view(np.int64)))
    return pa.table(
        {
            "id": names.column("id"), "key": names.column("key"), "n": pa.array(sizes),
            "digest": pa.array([x.tobytes() for x in digest], pa.binary()), "skipped": pa.array(singles), "tokens": tokens,
        }
    )


def t_occurrence(query: np.ndarray, candidates: list[np.ndarray]) -> list[int]:
    """Positions of the candidates that share enough hashes with ``query``; all sets sorted.

    The inverted list of a query hash names the candidates that have it. DivideSkip: the longest
    lists are put aside; the short ones are merged through a heap, and who occurs there often
    enough is looked up in the long ones by binary search.
    """
    wanted = [needed_overlap(query.size, c.size) for c in candidates]
    fits = [k for k, t in enumerate(wanted) if t <= min(query.size, candidates[k].size)]
    if not fits:
        return []
    owner = np.repeat(fits, [candidates[k].size for k in fits])
    hashes = np.concatenate([candidates[k] for k in fits])
    at = np.searchsorted(query, hashes)
    at[at == query.size] = 0
    hit = query[at] == hashes
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    lists = sorted((x.tolist() for x in np.split(owner, cuts)), key=len) if at.size else []
    least = min(wanted[k] for k in fits)
    if len(lists) < least:
        return []
    longest = len(lists[-1])
    aside = min(int(least / (PROBE_WEIGHT * math.log2(longest + 1) + 1)), least - 1, len(lists))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found, current, seen = [], -1, 0

    def settle():
        if current >= 0 and seen >= least - aside:
            total, open_ = seen, len(long)
            for line in reversed(long):
                if total + open_ < wanted[current]:
                    return
                place = bisect_left(line, current)
                total += place < len(line) and line[place] == current
                open_ -= 1
            if total >= wanted[current]:
                found.append(current)

    for name in heapq.merge(*short):
        if name != current:
            settle()
            current, seen = name, 0
        seen += 1
    settle()
    return found


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``: digests) that are similar: each ``a`` is a query, its
    partners the candidates, ``CANDIDATES`` of them at a time."""
    asked = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / CANDIDATES).cast("int")
    sized = asked.select("a", parts.alias("parts"))
    left = (
        pairs.join(sized, "a")
        .withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        .join(sets.select(F.col("digest").alias("b"), "hashes"), "b")
        .select("a", "part", "b", "hashes")
    )
    right = (
        sized.select(F.col("a").alias("_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"))
        .join(sets.select(F.col("digest").alias("_a"), F.col("hashes").alias("_query")), "_a")
        .select("_a", "_part", "_query")
    )

    def run(key, candidates, query):
        names = candidates.column("b").to_pylist()
        if not names or not query.num_rows:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        load = lambda x: np.frombuffer(x, np.uint64)
        hits = t_occurrence(load(query.column("_query")[0].as_py()), [load(x) for x in candidates.column("hashes").to_pylist()])
        return pa.table({"a": pa.array([key[0].as_py()] * len(hits), pa.binary()), "b": pa.array([names[k] for k in hits], pa.binary())})

    return left.groupBy("a", "part").cogroup(right.groupBy("_a", "_part")).applyInArrow(run, "a binary, b binary")


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart; null for a null text."""
    return F.unhex(F.md5(text.cast("binary")))


def _labelled(docs: DataFrame, id_column: str) -> DataFrame:
    """``id, key, n, label`` of every row of ``docs``: the key of its text, its shingles and its
    group, which is null without shingles."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col(id_column).cast("bigint").alias("_id"), F.col("text"), text_key(F.col("text")).alias("_key"))
    met = _postings(keyed, buckets).groupBy("bucket").applyInArrow(_meet, MET)
    rows, _ = freeze(met.groupBy("block").applyInArrow(_gather, "id bigint, key binary, n bigint, digest binary, skipped bigint, tokens array<bigint>"))
    nodes = (
        rows.where("n > 0 and size(tokens) > 0")
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.any_value(F.struct("n", "skipped", "tokens")).alias("s"))
        .select("digest", "id", "s.n", "s.skipped", "s.tokens")
    )
    nodes, _ = freeze(nodes)

    def hashed(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                grams, first = shingle_sets(part.column("text"))
                names = [x.tobytes() for x in digests(grams, first)]
                sets = [grams[a:b].tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["digest", "hashes"])
        give_back()

    texts = keyed.join(nodes.select(F.col("id").alias("_node")), F.col("_id") == F.col("_node")).select("text")
    made = texts.mapInArrow(hashed, "digest binary, hashes binary")
    # Sets that only rows without an id have are found by digest, where these rows lie.
    nameless = keyed.where("_id is null").select("text").mapInArrow(hashed, "digest binary, hashes binary")
    nameless = nameless.join(nodes.where("id is null").select("digest"), "digest", "left_semi")
    sets, _ = freeze(made.unionByName(nameless).groupBy("digest").agg(F.any_value("hashes").alias("hashes")))

    placed = nodes.select("digest", "n", "skipped", F.posexplode("tokens").alias("at", "token"))
    postings, _ = freeze(placed.select("digest", "n", (F.col("skipped") + F.col("at")).alias("at"), "token"))

    def may_be_first(n: str, at: str, m: str, place: str) -> Column:
        """Whether sets of ``n`` and ``m`` whose first shared hash is at these places can have the
        overlap they need: neither misses more than it may."""
        overlap = F.ceil((F.col(n) + F.col(m)) * ABOVE / (ABOVE + BELOW))
        return (F.col(at) <= F.col(n) - overlap) & (F.col(place) <= F.col(m) - overlap)

    leaders, _ = freeze(
        postings.groupBy("token")
        .agg(F.min(F.struct(F.col("at").alias("place"), "digest", F.col("n").alias("m"))).alias("l"), F.count(F.lit(1)).alias("members"))
        .where("members > 1")
        .select("token", F.col("l.digest").alias("leader"), "l.m", "l.place")
    )
    near = (
        postings.join(leaders, "token")
        .where((F.col("digest") != F.col("leader")) & may_be_first("n", "at", "m", "place"))
        .select(F.col("leader").alias("a"), F.col("digest").alias("b"))
        .distinct()
    )
    near, _ = freeze(near)
    links, _ = freeze(_verified(near, sets))
    labels = connected(links)
    # What shares a prefix hash and is not connected yet.
    named = postings.join(labels, F.col("digest") == F.col("node"), "left").select(
        "token", "digest", "n", "at", F.coalesce("label", "digest").alias("label")
    )
    named, _ = freeze(named)
    mixed = named.groupBy("token").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("token")
    open_, _ = freeze(named.join(mixed, "token", "left_semi"))
    other = open_.select("token", F.col("digest").alias("_d"), F.col("n").alias("_m"), F.col("at").alias("_place"), F.col("label").alias("_l"))
    rest = (
        open_.join(other, "token")
        .where((F.col("digest") < F.col("_d")) & (F.col("label") != F.col("_l")) & may_be_first("n", "at", "_m", "_place"))
        .select(F.col("digest").alias("a"), F.col("_d").alias("b"))
        .distinct()
        .join(near, ["a", "b"], "left_anti")
    )
    rest, _ = freeze(rest)
    more, found = freeze(_verified(rest, sets))
    if found:
        labels = connected(links.unionByName(more))
    of = rows.join(labels, F.col("digest") == F.col("node"), "left").select(
        "id", "key", "n", F.when(F.col("n") > 0, F.coalesce("label", "digest")).alias("label")
    )
    return freeze(of)[0]


def similar_groups(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The group of similar texts of every row of ``docs`` (whole-number id, ``text``; other
    columns are not read).

    A text's set holds its distinct runs of five words (A-Z lower-cased, words between ASCII white
    space); fewer words are one run; no words, or a null text, make an empty set, linked with
    nothing. Texts link when 100 * overlap >= 75 * union. Returns one row per input row: the id,
    ``n_shingles`` and ``component_id``, the smallest id reachable by links. Rows with a null
    id link like others but count in no smallest id; a group of null ids only has a null component. Rows of one id but different texts
    are texts of their own. Shingles are compared by 64-bit hashes.

    Exactness: equal sets are one node. A set misses at most a quarter of its hashes in a partner.
    So with its hashes in one order for all texts, rare ones first, it shares one of its first
    quarter (its prefix) with every partner, and a text with over a quarter in hashes of no other
    text has none. A pair is only formed at a hash that may be the first one both have. Where texts
    share a prefix hash, each is first compared with the one that has the fewest rarer hashes, such
    as the text that others were edited from; after that, whatever is still in different groups is
    compared too. So links within a group that is already connected need not be looked at, and no
    pair is left out.
    """
    of = _labelled(docs, id_column)
    smallest = of.where("n > 0").groupBy(F.col("label").alias("_l")).agg(F.min("id").alias("_smallest"))
    return of.join(smallest, F.col("label") == F.col("_l"), "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("_smallest")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with all its columns: of every group of similar texts the one with the smallest
    id, a null id last; of several texts under that id, the one with the smallest key. Exactly
    repeated ids and texts are kept once; texts without words are no group and stay."""
    of = _labelled(docs, id_column)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    first = of.where("n > 0").groupBy("label").agg(F.min(place).alias("f")).select("f.id", "f.key")
    kept = first.unionByName(of.where("n = 0").select("id", "key").distinct())
    kept = kept.select(F.col("id").alias("_kept"), F.col("key").alias("_its"))
    rows = docs.select(
        F.struct("*").alias("_row"), F.col(id_column).cast("bigint").alias("_id"), F.col("text").alias("_text"), text_key(F.col("text")).alias("_key")
    )
    return (
        rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & F.col("_key").eqNullSafe(F.col("_its")), "left_semi")
        .dropDuplicates(["_id", "_text"])
        .select("_row.*")
    )
