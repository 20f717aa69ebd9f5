"""Filter interactions, main text of pages and divergence of sources, against plain versions."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from llm_support import MESSY, documents, split
from pyspark.sql import functions as F
from support import SMALL, rows

from lapsewise.llm import audit, divergence, wrappers
from lapsewise.llm.queries import QUERIES

LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, 0), (7, 0, 1), (None, 1, 1), (99, 1, 1), (9, None, None)]


def labels(spark, data=LABELS):
    return spark.createDataFrame(data, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("x"))


def interactions(docs, marks):
    good = {d for d, q, _ in marks if d is not None and q == 1}
    toxic = {d for d, _, t in marks if d is not None and t == 1}
    least = {}
    for d, text, *_ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    judged = []
    for d, text, _, source, _ in docs:
        t, w = text or "", split(text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        judged.append((source or "", {k for k, x in fails.items() if x}, d in good, d in toxic))
    out = []
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        removed = {}
        for order in itertools.permutations("ABCDE"):
            for step, one in enumerate(order):
                removed["".join(order), step] = [j for j in mine if one in j[1] and not j[1] & set(order[:step])]
        shapley = Counter()
        for (order, step), gone in removed.items():
            shapley[order[step]] += len(gone)
        for (order, step), gone in removed.items():
            one = order[step]
            out.append((
                part, order, step + 1, sum(not j[1] & set(order[: step + 1]) for j in mine), len(gone),
                sum(one in j[1] for j in mine) - len(gone), sum(j[1] == {one} for j in mine),
                sum(j[2] for j in gone), sum(j[3] for j in gone), shapley[one],
            ))
    return sorted(out, key=repr)


COUNTED = (
    "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
)


def test_audit_against_every_order(spark):
    extra = [(20 + k, f"{'Word ' * (190 + k)}{'#' * (k % 2)}", "en", "d", 1) for k in range(20)] + [(5, "123 456 !!", "en", None, 10)]
    found = audit.audit(documents(spark, MESSY + extra), labels(spark))
    assert rows(found, *COUNTED) == interactions(MESSY + extra, LABELS)


def test_audit_of_nothing(spark):
    assert not rows(audit.audit(documents(spark).limit(0), labels(spark)))
    alone = audit.audit(documents(spark, [(None, None, None, None, None)]), labels(spark, []))
    assert alone.count() == 600 and alone.agg(F.sum("shapley")).first()[0] == 120 * 120  # it fails A only


def test_positional_counts_are_sums_of_bits():
    for n in (0, 1, 2, 3, 7, 1_000, 4_099):
        words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
        assert audit.positional_counts(words).tolist() == [int((words >> np.uint32(b) & 1).sum()) for b in range(32)]


def test_audit_task_sends_its_counts_on(spark, monkeypatch):
    monkeypatch.setattr(audit, "HELD_GROUPS", 1)
    assert rows(audit.audit(documents(spark), labels(spark)), *COUNTED) == interactions(MESSY, LABELS)


def test_text_failures_of_sliced_arrays():
    texts = pa.array(["zz", None, "A", "", "é|"]).slice(1)
    assert audit.text_failures(texts).tolist() == [1, 5, 1, 9]


def diverging(docs, least=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    upper = {c: c + 32 for c in range(65, 91)}
    used, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in docs:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(upper))
        groups.add((lang, source))
        used[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        p = shares(used[lang, source])
        pairs = []
        for other in {s for g, s in groups if g == lang and s != source}:
            q = shares(used[lang, other])
            pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other.encode(), other))
        q = shares(sum((used[g] for g in groups if g[0] == lang), Counter()))
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if used[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item, -value, rank + 1) for rank, (value, _, item) in enumerate(found)]
    return sorted(out, key=repr)


TALK = [
    (k, text, lang, source, 1)
    for k, (text, lang, source) in enumerate(
        [(f"Alpha beta gamma{k % 7} ÉTÉ été x{k % 3} alpha", ("en", "fr", None)[k % 3], (None, "a", "b", "é")[k % 4]) for k in range(60)]
        + [("only once here", "xx", "s"), (None, "xx", "t"), ("", "xx", None), ("12 34", "en", "numbers")]
        + [("beta " * 500, "en", "a"), (" ".join(f"t{k}x" for k in range(3_000)) * 2, "en", "b")]
    )
]


def test_divergence_against_sums_over_all_terms(spark):
    assert rows(divergence.divergence(documents(spark, TALK + MESSY))) == diverging(TALK + MESSY)


def test_divergence_in_many_blocks_tiles_and_drains(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 50), ("TILE", 2), ("HELD_TERMS", 5), ("STRIDE", 2)):
        monkeypatch.setattr(divergence, name, value)
    assert rows(divergence.divergence(documents(spark, TALK + MESSY).repartition(3), top=3)) == diverging(TALK + MESSY, top=3)


def test_divergence_of_nothing(spark):
    assert not rows(divergence.divergence(documents(spark).limit(0)))


def test_gallop_is_an_intersection():
    random = np.random.default_rng(3)
    for short, long in ((0, 5), (1, 1), (10, 4_000), (3_000, 3_000), (2_500, 60)):
        a, b = (np.unique(random.integers(0, 5_000, n)) for n in (short, long))
        in_a, in_b = divergence.gallop(a, b)
        assert a[in_a].tolist() == b[in_b].tolist() == np.intersect1d(a, b).tolist()


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([0, 10**13, 7 * 10**14 + 1], np.int64)
    total = 8 * 10**14 + 12345
    assert divergence.scaled(counts, total, 1_000).tolist() == [1 + 10**9 * (int(c) + 1) // (total + 1_000) for c in counts]


PAGE = (
    "<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style></head><body class='has-sidebar'><header><h1>Site</h1></header>"
    "<nav><ul><li><a>Menu {n}</a><li><a>More</a></ul></nav><div class='cookie-notice'>We use cookies {n}</div>"
    "{main}<aside>Side {n}</aside><form><label>Mail</label><input></form>"
    "<section class='comments'><article class='comment'><p>Reader {n}</p></article></section><footer>&copy; Foot {n}</footer></body></html>"
)


def page(n, body, wrap="article"):
    main = f"<{wrap}>{body}</{wrap.split()[0]}>"
    return PAGE.format(n=n, main=main)


def texts(spark, pages, **columns):
    made = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    found = wrappers.extract(made.select("*", *[F.lit(7).alias(c) for c in ("host", "_id", "_host", "plan", "wrapper", "text")]))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = found.collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return sorted((r.page_id if r.page_id is not None else -1, r.text) for r in got)


def test_main_text_of_articles(spark):
    host = "https://A.example.com/p"
    pages = [
        (1, host, page(1, "<h1>Head &amp; line</h1><p>One  <b>bold\n</b>word</p><script>var t='</p>';</script><p>Two<br>three<p>four")),
        (2, host, page(2, "<header><h1>Kept</h1></header><p>A</p><ul><li>x<li>y</ul><p>B</p><div class='ad'>Buy</div><h2>C</h2><p>&nbsp;D&eacute;</p>")),
        (3, host, page(3, "<p>A</p><!-- <p>no</p> --><table><tr><td>1<td>2</table><p>5 < 6 &lt; 7")),
        (3, host, page(3, "<p>A</p><!-- <p>no</p> --><table><tr><td>1<td>2</table><p>5 < 6 &lt; 7")),
        (4, host, ""), (5, host, None), (6, None, "plain text & more"), (None, "no url", "<p>null id"), (7, host, "<div hidden>x</div><nav>"),
        (8, "http://big.example.org", page(8, "<p>" + "w " * 200_000)), (9, "x://deep", "<div>" * 3_000 + "deep" + "</div>" * 3_000 + "end"),
        (10, "x://quote", '<p title="open>never closed <b>bold</b></p><p>next</p>'),
    ]
    assert texts(spark, pages) == [
        (-1, "null id"), (1, "Head & line\nOne bold word\nTwo three\nfour"), (2, "Kept\nA\nx\ny\nB\nC\nDé"),
        (3, "A\n1\n2\n5 < 6 < 7"), (3, "A\n1\n2\n5 < 6 < 7"), (4, ""), (5, ""), (6, "plain text & more"), (7, ""),
        (8, "w " * 199_999 + "w"), (9, "deep\nend"), (10, "never closed bold\nnext"),
    ]


def test_main_text_without_an_article(spark):
    """The part with most words in slots; what all pages of the host share is the template's."""
    story = "<p>{} tells a long story of {} with many words</p>"
    pages = [
        (n, "http://h/x", page(n, "<h4>All rights reserved by the house</h4>" + story.format(n, n + 1) * (1 + n % 3), "div class='body-7'"))
        for n in range(6)
    ]
    want = [(n, "\n".join([f"{n} tells a long story of {n + 1} with many words"] * (1 + n % 3))) for n in range(6)]
    assert texts(spark, pages) == want


def test_copies_of_one_page_are_no_template(spark):
    html = "<body><div><p>The same words on every page</p></div></body>"
    assert texts(spark, [(n, "http://h/x", html) for n in range(5)]) == [(n, "The same words on every page") for n in range(5)]


def test_signs_come_from_attributes_and_not_from_their_values():
    sign = wrappers._sign
    assert sign("p", ' title="a hidden ad" data-x=\'class="ad"\'') == "p"
    assert sign("p", " hidden") == sign("p", ' HIDDEN=""') == sign("p", " aria-hidden=true") == "p!"
    assert sign("div", ' class="post-12 Story" id=x') == "div.Story.post-"
    assert sign("div", " id='comments'") == "div!" and sign("ol", ' class=commentlist') == "ol!.commentlist"
    assert sign("div", ' class="lead" class="ad"') == "div.lead" and sign("div", ' role="main"') == "div^"
    assert sign("article", ' class="has-sidebar"') == "article^.has-sidebar" and sign("article", ' class="comment"') == "article!.comment"
    assert sign("header", "") == "header~" and sign("body", ' class="menu"') == "body.menu"


def test_no_pages(spark):
    assert texts(spark, []) == []


def test_result_without_broadcast_and_with_many_drains(spark, monkeypatch):
    want = rows(QUERIES["op12_html_extraction"](spark, SMALL))
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(wrappers, "HELD_HOSTS", 1)
    monkeypatch.setattr(wrappers, "KINDS", 2)
    assert rows(QUERIES["op12_html_extraction"](spark, SMALL)) == want
    # The tables' articles are plain enough to cut out with patterns.
    for page_id, _, text, _ in want:
        html = dict(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect())[page_id] if page_id < 20 else None
        if html:
            inside = re.search(r"<article>(.*)</article>", html, re.S)[1]
            blocks = (" ".join(wrappers.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inside))
            assert text == "\n".join(b for b in blocks if b)


def test_alignment_of_levels():
    def shape(*pages):
        whole = None
        for html in pages:
            one = wrappers.wrapper_of(wrappers.parse(html))
            whole = one if whole is None else wrappers.align(whole, one)
        return whole

    plain = shape("<h1>a</h1><p>b</p><p>c</p>", "<h1>d</h1><h2>x</h2><p>e</p>")
    assert plain["parts"] == [[False, [["h1", False]]], [False, [["h2", True]]], [True, [["p", False]]]]
    assert plain["kids"]["h1"]["kids"]["#"]["text"] is None
    mixed = shape("<p>a</p><h2>b</h2><p>c</p>", "<ul><li>z</ul><p>a</p>")
    assert mixed["parts"] == [[False, [["ul", True]]], [True, [["p", True], ["h2", True]]]]
    swapped = shape("<p>a</p><h2>b</h2>", "<h2>b</h2><p>a</p>")
    assert sorted(k for _, kinds in swapped["parts"] for k, _ in kinds) == ["h2", "p"] and swapped["parts"][0][0]
    same = shape("<p>a</p>", "<p>a</p>")
    assert same["kids"]["p"]["kids"]["#"]["text"] is not None
