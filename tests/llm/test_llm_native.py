"""URL filter, sharding, mixing and decontamination."""

import math
import random
import re
from collections import Counter

import pytest
from llm_support import MESSY, documents, split
from pyspark.sql import functions as F

from lapsewise.llm import decontaminate, mixing, sharding, url_filter
from support import plan_text

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.org", "", "block"), ("b.org", "", "allow"),
         (None, "/", "block"), ("", "/", "block"), ("c.org", None, "block"), ("d.org", "/", None)]


def judged(spark, urls, rules=RULES):
    pages = spark.createDataFrame([(n, u) for n, u in enumerate(urls)], "page_id bigint, url string")
    pages = pages.select("*", F.lit(1).alias("host"), F.lit(2).alias("rule"), F.lit(3).alias("_shape"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, table).collect()}


def test_urls(spark):
    got = judged(spark, [
        None, "", "no scheme/net/", "http://Example.NET/en/x?q#f", "http://net", "http://a.net/?x", "http://knet/", "https://x.b.org",
        "http://b.org#f", "http://c.org/", "http://d.org/", "http://" + "a." * 3000 + "net/" + "p" * 5000, "http://net/a\nb",
        "ftp://u@example.net:80/en/", "http://example.net/e",
    ])
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.net", "/en/x", "example.net/en/", "allow")
    assert got[4] == ("net", "", None, "allow")
    assert got[5] == ("a.net", "/", "net/", "block")
    assert got[6][2:] == (None, "allow")
    assert got[7] == ("x.b.org", "", "b.org", "block")
    assert got[8] == ("b.org", "", "b.org", "block")
    assert got[9][3] == got[10][3] == "allow"
    assert got[11][2] == "net/" and len(got[11][1]) == 5001
    assert got[12][1:3] == ("/a\nb", "net/")
    assert got[13] == ("u@example.net:80", "/en/", None, "allow")
    assert got[14][2:] == ("net/", "block")


def test_urls_without_rules_or_pages(spark):
    assert judged(spark, ["http://a.net/"], [])[0] == ("a.net", "/", None, "allow")
    pages = spark.createDataFrame([], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judge(pages, rules).count() == 0
    twice = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://a.net/")], "page_id bigint, url string")
    assert [r.verdict for r in url_filter.judge(twice, rules).collect()] == ["block"] * 3


def plain_table(shards, slots):
    """Turn by turn with the full preference lists written out."""
    names = sorted(shards)
    prefer = {}
    for n in names:
        offset, step = sharding._number(n, "offset") % slots, sharding._number(n, "step") % (slots - 1) + 1
        prefer[n] = [(offset + k * step) % slots for k in range(slots)]
    table = {}
    while len(table) < slots:
        for k, n in enumerate(names):
            if len(table) < slots:
                table[next(s for s in prefer[n] if s not in table)] = k
    return [table[s] for s in range(slots)]


def test_sharding_table():
    names = [f"s{k}" for k in range(7)]
    assert sharding.lookup_table(names, 1009).tolist() == plain_table(names, 1009)
    table = sharding.lookup_table(names)
    sizes = Counter(table.tolist())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(table.tolist(), fewer.tolist()) if a != 6)
    assert moved < 0.1 * sharding.SLOTS
    heavy = Counter(sharding.lookup_table({"a": 3, "b": 1}, 1009).tolist())
    assert heavy[0] > 2.9 * heavy[1]
    for bad in ([], {"a": 0}):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_sharding_rows(spark):
    docs = documents(spark).withColumn("shard", F.lit("old"))
    placed = sharding.place(docs, "doc_id", ["a", "b", "c"])
    rows = placed.collect()
    table = sharding.lookup_table(["a", "b", "c"])
    assert len(rows) == len(MESSY) and set(docs.columns) < set(placed.columns)
    assert all(r.shard == "abc"[table[r.slot]] for r in rows)
    assert len({(r.doc_id, r.slot) for r in rows}) == len({r.doc_id for r in rows})
    assert "Exchange hashpartitioning" not in plan_text(placed)
    assert sharding.place(docs.limit(0), "doc_id", ["a"]).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - cap * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def check_mix(docs, tolerance):
    texts = docs.select("doc_id", "text", "source").collect()
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    sizes = Counter()
    for r in texts:
        sizes[r.source] += len(split(r.text))
    target, taken = plain_targets(sizes), Counter()
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(split(r.text))) for r in texts)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= tolerance(sizes[s]), (s, taken[s], target[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def test_mix_messy(spark):
    check_mix(documents(spark), lambda size: size)
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mix_documents(spark):
    check_mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), lambda size: max(2, 0.005 * size))


def test_mixed_documents_keep_columns(spark):
    docs = documents(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +want


def test_mix_with_a_dominating_text(spark):
    """Every source on its own, in many hash orders: a text above the gap must not end the filling,
    and one that the target needs must not be left out."""
    names = "abcdefgh"
    rows = [(1000 * k + n, "w " * w, "en", s, 1) for k, s in enumerate(names) for n, w in enumerate([30_000] + [300] * (100 + k))]
    for share in (0.25, 0.75):
        taken, target = Counter(), {}
        for r in mixing.mix(documents(spark, rows), weights=(1,), share=share).collect():
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert min(target.values()) > 15_000 and all(abs(taken[s] - target[s]) < 300 for s in names), (taken, target)


def test_newton_reaches_the_targets(spark):
    goals = spark.createDataFrame([("a", 10, 20.0), ("b", 10, 1e-6), ("c", 10, 0.0), ("d", 0, 0.0)], "source string, source_size bigint, target double")
    got = {r.source: r.rate for r in mixing.rates(goals).collect()}
    assert got["a"] == pytest.approx(2) and got["b"] == pytest.approx(1e-7) and got["c"] == got["d"] == 0


def test_documents_are_tilted_by_their_size(spark):
    """Rates solve the balance: exponential in the size up to the cap, and the source's words meet its target."""
    rng = random.Random(4)
    sizes = {s: [rng.choice([1, 5, 40, 41, 300, 5_000]) for _ in range(60)] for s in "abc"}
    rows = [(100 * k + n, "w " * w, "en", s, 1) for k, (s, ws) in enumerate(sizes.items()) for n, w in enumerate(ws)]
    for share in (0.3, 1.2):
        got = mixing.mix(documents(spark, rows), share=share).collect()
        for s, ws in sizes.items():
            mine = [r for r in got if r.source == s]
            rate = {r.size: r.rate for r in mine}
            assert sum(r.size * r.rate for r in mine) == pytest.approx(mine[0].target, rel=1e-6)
            assert max(rate.values()) <= 2
            if mine[0].target < 2 * sum(ws) - 1e-6:
                tilt = {w: math.log(x) / w for w, x in rate.items() if x < 2 and w}
                assert len(set(rate.values())) > 1 and max(tilt.values()) == pytest.approx(min(tilt.values()), rel=1e-6, abs=1e-12)


def normal(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items, n=10):
    words, hit, found = normal(text), set(), set()
    for name, item in items:
        w = normal(item)
        size = min(n, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1) if w else ():
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(name)
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


ITEMS = [(1, "p3 P4 p5, p6 p7 p8 p9 p10 p11 p12 p13"), (10, "quick-brown FOX"), (2, None), (3, "..."), (None, "one"),
         (10, "Kein Mensch"), (4, "x x x x x x x x x x x x"), (5, "É ö")]


def test_decontamination(spark, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = [*MESSY, (20, "É ö É-ö é ö", "en", "a", 1), (21, " QUICK brown? fox", "en", "a", 1)]
    docs = documents(spark, rows)
    want = sorted(((r[0], *plain_hits(r[1], ITEMS)) for r in rows), key=str)
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
        found = decontaminate.contamination(docs, items)
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)
        assert got == want
        assert "Python" not in plan_text(found)
    clean = decontaminate.remove_documents(docs, items)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in rows if not plain_hits(r[1], ITEMS)[1])
    spans = decontaminate.remove_spans(docs, items)
    assert spans.columns == docs.columns and spans.count() == len(rows)
    assert not any(plain_hits(r.text, ITEMS)[1] for r in spans.where("doc_id in (6, 20, 21)").collect())
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert not decontaminate.contamination(docs, items.limit(0)).where("contaminated").count()
