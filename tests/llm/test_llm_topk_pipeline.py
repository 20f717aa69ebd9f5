"""Top-k search and the corpus pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from llm_support import MESSY, components, documents, split
from pyspark.sql import functions as F
from test_llm_native import plain_hits
from tokenizers import Tokenizer

import corpus_pipeline
from lapsewise.llm import topk
from lapsewise.session import freeze

SMALL = "/root/testdata/sf0.001"


def plain(vectors, queries, k):
    out = []
    for q, x in queries:
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_search_over_shards_and_blocks(spark):
    rng = random.Random(6)
    rows = [(n, [rng.randrange(-9, 10) for _ in range(5)]) for n in range(700)]
    rows += [(700 + n, [3, 3, 3, 3, 3]) for n in range(100)]  # ties
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>").withColumn("score", F.lit(1))
    got = topk.top_k(df, df.where("vec_id % 7 = 0"), 5, shard_rows=90, block_rows=30).collect()
    want = plain(rows, [r for r in rows if r[0] % 7 == 0], 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_search_of_messy_vectors(spark):
    rows = [(0, [1, 2]), (0, [1, 2]), (1, [5]), (2, None), (None, [1, 1]), (3, []), (4, [1 << 40, 0]), (5, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id in (0, 3)"), 20).collect())
    # Row 0 stands there twice: as a candidate, and as a query whose two rows find everything twice.
    assert [x[1] for x in got] == [1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5]
    assert [(q, i, s) for q, _, i, s in got if q == 0] == [(0, i, s) for i, s in ((4, 1 << 40), (1, 5), (5, 5), (3, 0)) for _ in range(2)]
    assert [(i, s) for q, _, i, s in got if q == 3] == [(0, 0), (0, 0), (1, 0), (4, 0), (5, 0)]
    assert topk.top_k(df.limit(0), df, 3).count() == 0
    assert topk.top_k(df, df.limit(0), 3).count() == 0
    assert topk.top_k(df.where("vec_id = 1"), df.where("vec_id = 1"), 3).count() == 0


def test_repeated_rows_match_the_sql(spark):
    """Copies of candidates and of queries over many shards and blocks, one id with a third of all rows."""
    rng = random.Random(9)
    rows = [(n, [rng.randrange(-9, 10) for _ in range(4)]) for n in range(200)]
    rows += [rng.choice(rows) for _ in range(200)] + [(40, [rng.randrange(-3, 4) for _ in range(4)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>").repartition(5)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 6, shard_rows=50, block_rows=20).collect()
    want = []
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for p, x in rows if p == q for i, y in rows if i != q)
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:6])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_quantized(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.01]), (1, None), (2, [nan]), (3, [inf, 1.0]), (4, [1.0, None]), (5, [])]
    got = topk.quantized(spark.createDataFrame(rows, "vec_id bigint, e array<float>"), "e").collect()
    assert {r.vec_id: r.vector for r in got} == {0: [32, -1], 5: []}


def test_boxes_bound_their_points():
    rng = np.random.default_rng(0)
    points = rng.integers(-50, 50, (500, 4))
    tree = topk.Tree.load(topk.Tree(np.arange(500), points).dump())
    query = rng.integers(-5, 5, (1, 4))
    for k in range(tree.begin.size):
        inside = tree.points[tree.begin[k] : tree.end[k]]
        assert (inside >= tree.low[k]).all() and (inside <= tree.high[k]).all()
        if inside.size:
            bound = (np.maximum(query, 0) @ tree.high[k] + np.minimum(query, 0) @ tree.low[k])[0]
            assert (inside @ query[0]).max() <= bound


def run_stages(spark, docs, folder):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs, _ = freeze(stage(spark, docs, folder))
        out.append(docs)
    return out


def test_pipeline_on_real_documents(spark):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    languages, joined, clean, mixed, ids = run_stages(spark, docs, SMALL)
    assert all(d.columns == docs.columns for d in (languages, joined, clean, mixed))
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    assert texts(languages) == texts(docs)
    groups = components(texts(languages))
    want = {d for d, (_, first) in groups.items() if d == first}
    assert set(texts(joined)) == want and joined.count() == len(want)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert set(texts(clean)) == {d for d, t in texts(joined).items() if not plain_hits(t, items)[1]}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= set(texts(clean)) and max(copies.values()) <= 2
    size = {d: len(split(t)) for d, t in texts(clean).items()}
    assert abs(sum(size[d] * n for d, n in copies.items()) / sum(size.values()) - 1.5) < 0.06  # eight documents a source
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in mixed.collect():
        found = tk.encode(r.text, add_special_tokens=False).ids + [2]
        want[r.doc_id, len(found), zlib.crc32(np.array(found, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in ids.collect()) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, ids.collect()))


def test_pipeline_on_messy_documents(spark):
    docs = documents(spark)
    stages = run_stages(spark, docs, SMALL)
    assert all(d.columns == docs.columns for d in stages[:-1])
    assert {r.doc_id for r in stages[0].collect()}.isdisjoint({2, 3, 4, 5})
    assert 1 not in {r.doc_id for r in stages[1].collect()}
    assert len(MESSY) > stages[0].count() > stages[1].count()
    assert [d.count() for d in run_stages(spark, docs.limit(0), SMALL)] == [0] * 5
