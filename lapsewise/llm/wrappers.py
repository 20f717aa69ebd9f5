"""Main text of web pages, by wrappers that are inferred from the pages of a host."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.arrays import pieces
from lapsewise.session import freeze

#: Open elements beyond this depth are read as part of the one they stand in.
DEPTH = 150
#: A level with more kinds of elements than this tells them apart by name alone.
KINDS = 64
#: Hosts whose wrappers a task holds before it sends them on.
HELD_HOSTS = 2_000
#: First merge of a host's wrappers: so many groups, each as a stream.
SPREAD = 64
#: Bytes of all plans together that are sent to every executor.
BROADCAST_BYTES = 32 << 20
#: Share of the words below an element that a part must hold to be the place of the main text.
MAIN_SHARE = 0.6
#: Pages a host must have before a text they all share counts as part of the template.
TEMPLATE_PAGES = 3

TEXT = "#"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
HOLDERS = frozenset("ul ol dl table body html article section div main td".split())
DROPPED = frozenset(
    "head title script style noscript template iframe textarea nav footer aside form button select option input label "
    "fieldset svg math canvas object audio video map menu dialog noembed noframes datalist xmp".split()
)
#: Words in class, id or role that say what a part of a page is.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar aside "
    "complementary widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer contentinfo copyright "
    "comment comments reply replies respond disqus discussion share sharing social related recommended recommendations "
    "toolbar search form dialog commentlist commentform adsbygoogle adslot adbox adunit topnav sidenav subnav submenu".split()
)
#: These count outside the article only, and the second set alone counts on an article itself.
PAGE_MARKS = frozenset("header masthead topbar".split())
ARTICLE_MARKS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended teaser".split())
MAIN = frozenset(["article", "main"])

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("name", "sign", "kids")

    def __init__(self, name: str, sign: str):
        self.name, self.sign, self.kids = name, sign, []


def _sign(name: str, attributes: str) -> str:
    """Kind of an element: its name, its classes without their digits, ``!`` where it is no main
    text, ``^`` where it is main text."""
    found: dict[str, str] = {}
    for k, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), a or b or c)  # of repeated attributes the first counts
    words = set(re.split(r"[^a-z]+", " ".join(found.get(k, "") for k in ("class", "id", "role")).lower())) if found else set()
    main = name in MAIN or "main" in found.get("role", "").lower().split()
    if name in ("html", "body", "main"):
        drop = False
    elif name == "article":
        drop = bool(words & ARTICLE_MARKS)
    else:
        drop = name in DROPPED or bool(words & MARKS) or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    mark = "!" if drop else "^" if main else "~" if name == "header" or words & PAGE_MARKS else ""
    classes = re.sub(r"\d+", "", found.get("class", "")).split()
    return ".".join([name + mark, *sorted(set(classes))])


def _plain(sign: str) -> str:
    return sign.split(".", 1)[0]


def parse(html: str) -> Node:
    """The page as a tree. Unclosed and stray tags are tolerated: a paragraph ends where a block
    begins, an end tag closes the element it names, inline ones not beyond their block."""
    root = Node("", "")
    stack = [root]
    lost: Counter = Counter()
    at, end = 0, len(html)
    signs: dict[tuple, str] = {}
    while at < end:
        to = html.find("<", at)
        if to < 0:
            to = end
        if to > at:
            stack[-1].kids.append(html[at:to])
        if to == end:
            break
        if html.startswith("<!--", to):
            done = html.find("-->", to + 4)
            at = end if done < 0 else done + 3
            continue
        if html.startswith(("<!", "<?"), to):
            done = html.find(">", to)
            at = end if done < 0 else done + 1
            continue
        tag = TAG.match(html, to)
        if tag is None:
            stack[-1].kids.append("<")
            at = to + 1
            continue
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        name = name.lower()
        if closing:
            if lost[name]:
                lost[name] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in BLOCKS and name not in BLOCKS:
                    break
            continue
        if name in BLOCKS:
            ends = CLOSES.get(name, frozenset())
            for k in range(len(stack) - 1, 0, -1):
                # A block ends an open paragraph, an item the item before it in the same list.
                if stack[k].name == "p" or stack[k].name in ends:
                    del stack[k:]
                    if stack[-1].name in ends:
                        continue
                    break
                if stack[k].name in HOLDERS:
                    break
        key = (name, attributes)
        sign = signs.get(key)
        if sign is None:
            sign = signs[key] = _sign(name, attributes)
        node = Node(name, sign)
        stack[-1].kids.append(node)
        if name in RAW and not attributes.endswith("/"):
            close = re.compile(f"</{name}[^>]*>", re.I).search(html, at)
            if close is None:
                node.kids.append(html[at:])
                at = end
            else:
                node.kids.append(html[at : close.start()])
                at = close.end()
        elif name in VOID or attributes.endswith("/") and name not in BLOCKS:
            pass
        elif len(stack) <= DEPTH:
            stack.append(node)
        else:
            lost[name] += 1
    return root


# A wrapper is a union-free expression over the kinds of one level, with a wrapper inside each
# kind: {"parts": [[repeated, [[kind, optional], ...]], ...], "kids": {kind: wrapper}, "n": how
# often, "words": of its own texts, "text": their common digest, None for a slot}.


def _fold(flat: list, spans: list, plain: bool) -> dict:
    """Parts of a level. A kind that recurs makes a repeated group of all from its first place to
    its last; ``spans`` are groups that are known already. So each kind stands in one place."""
    if not plain and len({kind for kind, _, _ in flat}) > KINDS:
        plain = True
    if plain:
        flat = [(_plain(kind), optional, inner) for kind, optional, inner in flat]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for k, (kind, _, _) in enumerate(flat):
        first.setdefault(kind, k)
        last[kind] = k
    reach = sorted([*spans, *((first[x], last[x]) for x in first if last[x] > first[x])])
    merged: list[list[int]] = []
    for a, b in reach:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    parts: list = []
    kids: dict[str, dict] = {}
    at = 0
    for a, b in [*merged, [len(flat), len(flat) - 1]]:
        for kind, optional, inner in flat[at:a]:
            parts.append([False, [[kind, optional]]])
            kids[kind] = inner
        if a <= b:
            options: dict[str, bool] = {}
            for kind, optional, inner in flat[a : b + 1]:
                options[kind] = options.get(kind, True) and optional
                kids[kind] = align(kids[kind], inner) if kind in kids else inner
            alone = len(options) == 1
            parts.append([True, [[kind, optional if alone else True] for kind, optional in options.items()]])
        at = b + 1
    return {"parts": parts, "kids": kids, "plain": plain}


def _flat(wrapper: dict) -> tuple[list, list]:
    flat, spans = [], []
    for repeated, kinds in wrapper["parts"]:
        if repeated:
            spans.append((len(flat), len(flat) + len(kinds) - 1))
        flat += [(kind, optional, wrapper["kids"][kind]) for kind, optional in kinds]
    return flat, spans


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: dict, b: dict) -> dict:
    """The wrapper of what either of two wrappers fits. Texts that differ become a slot, kinds that
    one side lacks become optional, kinds that recur or change places a repeated group."""
    out = {"n": a["n"] + b["n"], "words": a["words"] + b["words"], "text": a["text"] if a["text"] == b["text"] else None}
    if a["parts"] == b["parts"] and a["plain"] == b["plain"]:
        kids = {kind: align(inner, b["kids"][kind]) for kind, inner in a["kids"].items()}
        return out | {"parts": a["parts"], "kids": kids, "plain": a["plain"]}
    if a["plain"] != b["plain"]:
        level = {x: _fold(*_flat(w), True) for x, w in (("a", a), ("b", b))}
        a, b = a | level["a"], b | level["b"]
    (left, spans_a), (right, spans_b) = _flat(a), _flat(b)
    pairs = _matches([x[0] for x in left], [x[0] for x in right])
    flat, at_a, at_b = [], [], []
    i = j = 0
    for p, q in [*pairs, (len(left), len(right))]:
        for kind, _, inner in left[i:p]:
            at_a.append(len(flat))
            flat.append((kind, True, inner))
        for kind, _, inner in right[j:q]:
            at_b.append(len(flat))
            flat.append((kind, True, inner))
        if p < len(left):
            at_a.append(len(flat))
            at_b.append(len(flat))
            flat.append((left[p][0], left[p][1] or right[q][1], align(left[p][2], right[q][2])))
        i, j = p + 1, q + 1
    spans = [(at_a[x], at_a[y]) for x, y in spans_a] + [(at_b[x], at_b[y]) for x, y in spans_b]
    return out | _fold(flat, spans, a["plain"])


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def wrapper_of(node: Node) -> dict:
    """A page's own wrapper."""
    flat = []
    for kid in node.kids:
        if isinstance(kid, str):
            words = kid.split()
            if words:
                leaf = {"n": 1, "words": len(words), "text": _digest(" ".join(words)), "parts": [], "kids": {}, "plain": False}
                flat.append((TEXT, False, leaf))
        elif "!" in kid.sign or kid.name in VOID:
            flat.append((kid.sign, False, {"n": 1, "words": 0, "text": "", "parts": [], "kids": {}, "plain": False}))
        else:
            flat.append((kid.sign, False, wrapper_of(kid)))
    return {"n": 1, "words": 0, "text": ""} | _fold(flat, [], False)


def _slot_words(wrapper: dict, fixed: int) -> int:
    """Words in slots below a wrapper, without what is never main text."""
    own = 0 if fixed and wrapper["text"] and wrapper["n"] >= fixed else wrapper["words"]
    return own + sum(_slot_words(w, fixed) for kind, w in wrapper["kids"].items() if "!" not in _plain(kind))


def plan_of(wrapper: dict) -> dict:
    """What to take from the pages that a host's wrapper fits: ``{kind: [main, dense, kids]}``.

    ``main``: the texts in it stand in an article or the main part; ``dense``: they stand in the
    part that holds most words of the host's slots, for pages that mark no main part. A text that
    all of at least three pages share, which are not all the same, belongs to the template.
    """
    fixed = wrapper["n"] if wrapper["n"] >= TEMPLATE_PAGES and not wrapper["text"] else 0
    path: list[str] = []
    level = wrapper
    while True:
        total = _slot_words(level, fixed)
        single = {kinds[0][0] for repeated, kinds in level["parts"] if not repeated}
        within = [
            kind for kind in level["kids"]
            if kind in single and kind != TEXT and "!" not in _plain(kind) and _plain(kind).rstrip("^~") in BLOCKS - {"p"}
            and total and _slot_words(level["kids"][kind], fixed) >= MAIN_SHARE * total
        ]
        if not within:
            break
        path.append(within[0])
        level = level["kids"][within[0]]

    def walk(level: dict, way: list | None, main: bool) -> dict:
        """``way``: what is left of the path, None off it."""
        out = {}
        for kind, inner in level["kids"].items():
            name = _plain(kind)
            if kind == TEXT:
                template = bool(fixed and inner["text"] and inner["n"] >= fixed)
                out[kind] = [main, way == [] and not template, {}]
            elif "!" not in name and not ("~" in name and not main):
                inside = [] if way == [] else way[1:] if way and way[0] == kind else None
                kids = walk(inner, inside, main or "^" in name)
                if kids:
                    out[kind] = [main or "^" in name, inside == [], kids]
            elif "~" in name:
                kids = walk(inner, None, False)  # an article may stand in a page's header
                if kids:
                    out[kind] = [False, False, kids]
        return out

    return walk(wrapper, path, False)


def main_text(page: Node, plan: dict) -> str:
    """Text of a page by its host's plan: blocks in page order, white space inside made one space."""

    def blocks(column: int) -> str:
        lines: list[str] = []
        held: list[str] = []

        def flush():
            line = " ".join(unescape("".join(held)).split()) if held else ""
            if line:
                lines.append(line)
            held.clear()

        def walk(node: Node, known: dict):
            for kid in node.kids:
                if isinstance(kid, str):
                    if TEXT in known and known[TEXT][column]:
                        held.append(kid)
                    elif held:
                        held.append(" ")
                    continue
                if kid.name in BLOCKS:
                    flush()
                elif kid.name == "br":
                    held.append(" ")
                there = known.get(kid.sign) or known.get(_plain(kid.sign))
                if there:
                    walk(kid, there[2])
                if kid.name in BLOCKS:
                    flush()

        walk(page, plan)
        flush()
        return "\n".join(lines)

    return blocks(0) or blocks(1)


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, question mark, hash or the end, A-Z made
    small; empty for a null or other url."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.lower(found)


def infer(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON) of pages with ``host`` and ``html``.

    A task aligns the pages of each of its hosts as they come; then wrappers, whose size is that of
    a template, are aligned as streams, first in 64 groups for each host.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        group = TaskContext.get().partitionId() % SPREAD

        def drain() -> pa.RecordBatch:
            rows = sorted(held.items())
            held.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in rows], pa.string()), pa.array([group] * len(rows), pa.int32()),
                    pa.array([json.dumps(w) for _, w in rows], pa.string()),
                ],
                ["host", "group", "wrapper"],
            )

        for batch in batches:
            for part in pieces(batch, "html", 1 << 20):
                for name, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    own = wrapper_of(parse(html)) | {"text": _digest(html)}
                    held[name] = align(held[name], own) if name in held else own
                    if len(held) >= HELD_HOSTS:
                        yield drain()
        yield drain()

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict | None = None
        for batch in batches:
            for text in batch.column("wrapper"):
                one = json.loads(text.as_py())
                whole = one if whole is None else align(whole, one)
        names = ["host", "group", "wrapper"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.string()), pa.array([0], pa.int32()), pa.array([json.dumps(whole)], pa.string())], names
        )

    schema = "host string, group int, wrapper string"
    partial = pages.select("host", "html").mapInArrow(first, schema)
    return partial.groupBy("host", "group").applyInArrow(merged, schema).groupBy("host").applyInArrow(merged, schema).select("host", "wrapper")


def extract(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """The main text of every row of ``pages`` (id, ``url``, ``html``): the id, ``url``, ``text`` and
    ``n_chars``, its code points.

    Same-host token streams are aligned into a wrapper; its slots are judged once for each host
    (``plan_of``) and read from all pages. Menus, headers, footers, side bars, notices, adverts,
    forms, comments and the like are known by element names and class words. The result does not
    depend on the order of alignment, as all it uses are sums, common texts and the kinds that
    stand inside each other. Null html is empty and gives an empty text; null and other urls share
    a wrapper; repeated rows give equal rows; an empty table gives no rows.
    """
    kind = pages.schema[id_column].dataType.simpleString()
    rows = pages.select(
        F.col(id_column).alias("_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        host(F.col("url")).alias("host"),
    )

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = [json.dumps(plan_of(json.loads(x.as_py()))) for x in batch.column("wrapper")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(plans, pa.string())], ["_host", "plan"])

    plans, _ = freeze(infer(rows).mapInArrow(planned, "_host string, plan string"))
    size = plans.agg(F.coalesce(F.sum(F.octet_length("plan") + F.octet_length("_host") + 100), F.lit(0))).first()[0]
    known = F.broadcast(plans) if size <= BROADCAST_BYTES else plans

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of, plan = None, {}
        for batch in batches:
            for part in pieces(batch, "html", 1 << 20):
                texts = []
                for html, wanted in zip(part.column("html").to_pylist(), part.column("plan").to_pylist()):
                    if wanted != text_of:
                        text_of, plan = wanted, json.loads(wanted)
                    texts.append(main_text(parse(html), plan))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["_id", "url", "text", "n_chars"],
                )

    joined = rows.join(known, F.col("host") == F.col("_host")).select("_id", "url", "html", "plan")
    schema = f"_id {kind}, url string, text string, n_chars bigint"
    return joined.mapInArrow(read, schema).withColumnRenamed("_id", id_column)
