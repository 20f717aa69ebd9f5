"""Scoring, language identification, token ids, repeated passages and the Jaccard join."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import LONG, MESSY, PASSAGE, components, documents, kept_words, split
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lapsewise.llm import jaccard, language, passages, scoring, tokens
from lapsewise.llm.arrays import Words
from lapsewise.llm.components import connected

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


def real(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def held(doc_id, folds):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 2


@given(st.lists(st.text(alphabet="aB \t\n\x0b\x1c é ", max_size=12) | st.none(), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_split_like_bytes(texts):
    words = Words(pa.array(texts, pa.string()), lower=True)
    for k, text in enumerate(texts):
        got = [words.text(w) for w in range(words.first[k], words.first[k + 1])]
        assert got == (text or "").encode().lower().split()
    hashes, seen = words.hashes(), {}
    for w, h in enumerate(hashes.tolist()):
        assert seen.setdefault(words.text(w), h) == h
    assert len(set(seen.values())) == len(seen)


# Scoring


def check_base(docs):
    texts = docs.select("doc_id", "text").collect()
    token = lambda text: [w.lower() for w in split(text)] + [None]
    train = Counter(w for r in texts if not held(r.doc_id, 7) for w in token(r.text))
    n, v = sum(train.values()), len(train)
    want = sorted(
        (str(r.doc_id), held(r.doc_id, 7), len(token(r.text)), sum(w in train for w in token(r.text)), n,
         round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in token(r.text)), 6))
        for r in texts
    )
    rows = scoring.score(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    return rows


def test_scores_of_messy_documents(spark):
    rows = check_base(documents(spark))
    assert len({(r.doc_id, r.score) for r in rows if r.doc_id == 1}) == 1
    assert scoring.score(documents(spark, [])).count() == 0
    one = scoring.score(documents(spark, [(2, "only held out", "en", "a", 1)]).where(F.crc32(F.lit("2").cast("binary")) > 0)).collect()
    assert len(one) == 1 and math.isfinite(one[0].score)


def test_scores_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in scoring.score(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_model_is_normalised(monkeypatch):
    rng = np.random.default_rng(1)
    model = scoring.LogBilinear.start(np.full(scoring.UNITS, 1 / scoring.UNITS))
    model.q = rng.normal(0, 0.5, model.q.shape)
    first, second, z = model.tables()
    total = np.exp(first[3].astype(float) + second[9] - z[3, 9]).sum()
    assert total == pytest.approx(1, abs=1e-4)
    units = rng.integers(0, 4, 20_000).astype(np.int32)
    units[1::2] = units[::2]  # every second unit repeats the one before
    one, two = scoring._contexts(units)
    noise = np.full(scoring.UNITS, 1e-9)
    noise[:4] = 0.25
    taught = scoring.LogBilinear.start(noise)
    squares = [np.zeros_like(x) for x in (taught.r, taught.q, taught.a, taught.b)]
    for _ in range(6):
        taught.learn(units, one, two, noise, squares, rng)
    a, b, z = taught.tables()
    mean = (a[one, units] + b[two, units] - z[one, two]).mean()
    assert mean > math.log(0.25) + 0.1


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Many pieces in all rounds, rows in any order, one text with a third of all rows."""
    monkeypatch.setattr(scoring, "PIECE_WORDS", 2_000)
    docs = real(spark)
    one = docs.where("doc_id = 3")
    for _ in range(6):
        one = one.union(one)
    docs = docs.union(one)
    few = scoring.score(docs.repartition(2)).select("doc_id", F.round("score", 6).alias("score"))
    many = scoring.score(docs.orderBy(F.rand(5)).repartition(17)).select("doc_id", F.round("score", 6).alias("score"))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_more_text_makes_a_better_model(spark):
    """What a held-out token gains over the base, learnt from a third and from all of the texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def gain(some):
        row = scoring.score(some).where("held_out and doc_id % 3 = 0").agg(F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).first()
        return row[0]

    assert gain(docs) > gain(docs.where("doc_id % 3 = 0")) + 0.02


def test_class_of_a_word_is_the_same_in_sql(spark):
    words = [b"a", "é".encode(), b"abc", "xyzé".encode(), b"0", b"ab"]
    df = spark.createDataFrame([(w,) for w in words], "word binary")
    got = [r.c for r in df.select(scoring._class_column(F.col("word")).alias("c")).collect()]
    assert got == [scoring.word_class(w) for w in words]


# Language


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth)
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == held(r.doc_id, 4) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) > 0.97 * len(out)
    clean = language.keep_identified(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()


def test_mixture_of_two_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 300")
    by = {r.lang: r.text for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    model = language.learn(docs)
    both = " ".join(by["de"].split()[:200] + by["fr"].split()[:100])
    name, score, parts = language.infer(pa.array([both, by["de"]]), model)[0]
    assert name == "de" and [p[0] for p in parts] == ["de", "fr"] and parts[0][1] == pytest.approx(2 / 3, abs=0.08)
    assert len(language.infer(pa.array([by["de"]]), model)[0][2]) == 1


def test_languages_of_messy_documents(spark):
    docs = documents(spark)
    rows = language.identify(docs).collect()
    assert len(rows) == len(MESSY)
    learned = {r[2] for r in MESSY if r[2] and not held(r[0], 4)}
    for r in rows:
        assert r.lang_pred in learned | {"und"}
        if r.doc_id in (2, 3, 4, 5):
            assert (r.lang_pred, r.score) == ("und", 0)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {2, 3, 4, 5}.isdisjoint({r.doc_id for r in kept.collect()})
    assert language.identify(docs.limit(0)).count() == 0
    unlearned = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}


def test_predictions_use_the_text_only(spark):
    docs = real(spark)
    other = docs.select("doc_id", "text", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.col("lang")).otherwise("zz").alias("lang"), "source", "n_chars")
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(df).collect())
    assert key(docs) == key(other)


# Token ids


def check_ids(docs, path):
    tokens.write_ids(docs, path, TOKENIZER)
    tk = Tokenizer.from_file(TOKENIZER)
    want = Counter((r.doc_id, tuple(tk.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in docs.collect())
    rows = tokens.read_ids(docs.sparkSession, path).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    names = [r.doc_id for r in sorted(rows, key=lambda r: r.start) if r.doc_id is not None]
    assert names == sorted(names)


def test_ids_of_messy_documents(spark, tmp_path, monkeypatch):
    odd = [(30, "a  b  c\x1d d 　 e", "en", "a", 1), (31, "  lead  and trail \n\n ", "en", "a", 1),
           (32, "x <|endoftext|> y<|endoftext|>", "en", "a", 1), (33, "don't  stop'll 123abc \r\n\t ok", "en", "a", 1), (-5, "neg", None, None, 1)]
    check_ids(documents(spark, MESSY + odd), str(tmp_path / "a"))
    check_ids(documents(spark, []), str(tmp_path / "b"))


def test_ids_of_real_documents(spark, tmp_path):
    check_ids(real(spark), str(tmp_path / "a"))


@given(st.lists(st.text(alphabet="ab é\t\n　 'x1<|>", max_size=30), max_size=5))
@settings(max_examples=60, deadline=None)
def test_chunks_give_the_ids_of_the_text(texts):
    if not hasattr(test_chunks_give_the_ids_of_the_text, "encoder"):
        with open(TOKENIZER, encoding="utf-8") as file:
            test_chunks_give_the_ids_of_the_text.encoder = tokens.Encoder(file.read())
    encoder = test_chunks_give_the_ids_of_the_text.encoder
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == want


def test_block_decodes_single_documents():
    rng = random.Random(3)
    phrases = [[rng.randrange(50_000) for _ in range(6)] for _ in range(20)]
    docs = [np.array([x for _ in range(rng.randrange(60)) for x in rng.choice(phrases)], np.int32) for _ in range(80)]
    docs += [np.zeros(0, np.int32), np.array([7] * 500, np.int32)]
    data = tokens.pack(docs)
    block = tokens.Block(data)
    assert block.rules.shape[1] > 20 and len(data) < 0.5 * sum(2 * d.size for d in docs)
    everything = block.all()
    for k, d in enumerate(docs):
        assert block.document(k).tolist() == everything[k].tolist() == [*d.tolist(), 2]
    assert block.lengths.min() >= 2
    with pytest.raises(ValueError):
        tokens.Block(b"none" + data[4:])


# Repeated passages


def check_passages(docs):
    texts = docs.select("doc_id", "text").collect()
    want = sorted(
        (str(r.doc_id), len(split(r.text)), len(split(r.text)) - len(k), b" ".join(k).decode()) for r, k in zip(texts, kept_words([r.text for r in texts]))
    )
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in passages.remove_repeats(docs).collect())
    assert got == want
    return got


def repeating(seed=5):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [[word() for _ in range(n)] for n in (34, 35, 36, 70, 140)]
    rows = []
    for n in range(60):
        text = [word() for _ in range(rng.randrange(50))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passage)
            a = rng.randrange(len(p) // 3)
            text += p[a : a + rng.randrange(20, 150)] + [word() for _ in range(rng.randrange(10))]
        rows.append((n, " ".join(text), "en", "a", 1))
    rows += [(100, "a b c " * 50, "en", "a", 1), (101, "z " * 36, "en", "a", 1), (102, "z " * 35, "en", "a", 1), (103, "A B C " * 12, "en", "a", 1)]
    return rows


def test_passages(spark):
    got = check_passages(documents(spark, repeating()))
    assert sum(r[2] > 0 for r in got) > 20


def test_passages_of_messy_documents(spark):
    got = {r[0]: r for r in check_passages(documents(spark))}
    assert got["6"][2] == got["7"][2] == 60 and got["8"][1] == 120 and PASSAGE not in got["6"][3]
    assert got["9"][1] == len(LONG.split())
    assert passages.remove_repeats(documents(spark, [])).count() == 0


def test_passages_at_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(passages, "HOT_RUNS", 2)
    check_passages(documents(spark, repeating(9)))


def test_passages_in_small_shards(spark):
    line = b" ".join(b"q%d" % n for n in range(40))
    groups = [[(line, 2)], [(b" ".join(b"r%d" % n for n in range(35)), 1)]]
    assert passages.recurring(groups, 35) == {line: [(0, 40)]}


# Jaccard join


def check_groups(docs):
    texts = docs.select("doc_id", "text").collect()
    want = components({r.doc_id: r.text for r in texts})
    rows = jaccard.similar_groups(docs).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    return want


def near_copies(seed=2):
    """Chains, groups around one text, copies, and texts that share much but too little."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, n = [], 0
    for size in (8, 20, 60, 200, 40, 12):
        text = [word() for _ in range(size)]
        for _ in range(12):
            rows.append((n, " ".join(text), "en", "a", 1))
            n += 1
            text = list(text)
            for _ in range(rng.randrange(1, max(2, size // 30) + 1)):
                text[rng.randrange(size)] = word()
        common = [word() for _ in range(int(size * 0.85))]
        for _ in range(10):
            rows.append((n, " ".join(common + [word() for _ in range(size - len(common))]), "en", "a", 1))
            n += 1
    rng.shuffle(rows)
    return rows


def test_groups(spark):
    want = check_groups(documents(spark, near_copies()))
    sizes = Counter(c for _, c in want.values())
    assert max(sizes.values()) > 5 and len(sizes) > 20


def test_groups_of_messy_documents(spark):
    rows = [r for r in MESSY if r[0] is not None and r[0] != 1]
    check_groups(documents(spark, rows))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(documents(spark)).collect()}
    assert {(0, 8, 0), (1, 8, 0), (2, 0, 2), (3, 0, 3), (4, 0, 4), (10, 1, 10), (11, 1, 10), (12, 8, 0), (None, 0, None)} <= got
    kept = jaccard.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and not ids[1] and not ids[11] and not ids[12] and ids[2] == ids[3] == ids[4] == 1
    assert jaccard.similar_groups(documents(spark, [])).count() == 0


def test_null_and_repeated_ids_link(spark):
    text = [f"n{k}" for k in range(100)]

    def edited(base, *places):
        return " ".join("other" + str(k) if k in places else w for k, w in enumerate(base))

    other, third, fourth = ([f"{c}{k}" for k in range(100)] for c in "opq")
    rows = [
        # A bridge: 20 and 21 are similar to the nameless text only.
        (20, edited(text, 10, 30)), (None, edited(text)), (21, edited(text, 50, 70)),
        (30, edited(other)), (None, edited(other, 50)),
        (None, edited(third)), (None, edited(third, 50)),
        (40, edited(fourth)), (40, edited(fourth, 50)), (40, "all alone here"),
    ]
    docs = documents(spark, [(n, x, "en", "a", 1) for n, x in rows])
    got = Counter((r.doc_id, r.component_id) for r in jaccard.similar_groups(docs).collect())
    assert got == {(20, 20): 1, (21, 20): 1, (None, 20): 1, (30, 30): 1, (None, 30): 1, (None, None): 2, (40, 40): 3}
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()]
    assert sorted(str(n) for n, _ in kept) == ["20", "30", "40", "40", "None"]
    assert (40, "all alone here") in kept and all(x in (rows[5][1], rows[6][1]) for n, x in kept if n is None)


def test_many_edited_copies(spark):
    rng = random.Random(4)
    base = [f"b{n}" for n in range(120)]
    rows = []
    for n in range(300):
        text = list(base)
        text[rng.randrange(120)] = f"e{n}"
        rows.append((n, " ".join(text), "en", "a", 1))
    rows += [(300 + n, " ".join(base), "en", "a", 1) for n in range(50)]
    got = jaccard.similar_groups(documents(spark, rows)).collect()
    assert {r.component_id for r in got} == {0}


@given(st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_t_occurrence_equals_counting(seed):
    rng = np.random.default_rng(seed)
    query = np.unique(rng.integers(0, 80, rng.integers(1, 60)).astype(np.uint64))
    candidates = []
    for _ in range(rng.integers(1, 30)):
        some = query[rng.random(query.size) < rng.choice([0.5, 0.9, 1.0])]
        candidates.append(np.unique(np.concatenate([some, rng.integers(0, 80, rng.integers(0, 6)).astype(np.uint64)])))
    want = []
    for k, c in enumerate(candidates):
        both = np.intersect1d(query, c).size
        if 100 * both >= 75 * (query.size + c.size - both):
            want.append(k)
    assert sorted(jaccard.t_occurrence(query, candidates)) == want


def test_components(spark):
    rng = random.Random(1)
    links = [(n, n + 1) for n in range(0, 40)] + [(100, 100)] + [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(25)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hashes_of_kept_text(spark):
    docs = documents(spark).where("doc_id = 6")
    row = passages.remove_repeats(docs).withColumn("h", F.sha2("text", 256)).collect()[0]
    assert row.h == hashlib.sha256(b" ".join(split(MESSY[9][1]))).hexdigest()
