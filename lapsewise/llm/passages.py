"""Removal of passages that repeat anywhere in the corpus, located by Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.arrays import Words, pieces
from lapsewise.session import freeze

#: Words of a window, and of the runs by which equal windows find each other.
WINDOW, ANCHOR = 35, 8
#: Words of the segments that one automaton is built for and run over.
SHARD_WORDS = 1_000_000
#: Beyond so many runs with one anchor, windows are counted by sums instead of in one task.
HOT_RUNS = 10_000
_SURROGATES = 0xD800


def anchor_runs(words: Words, hashes: np.ndarray, window: int, anchor: int):
    """Runs of windows of one text with the same anchor: ``text, anchor, start, windows, places``.

    A window's anchor is the smallest hash among its runs of ``anchor`` words, so equal windows
    have equal anchors, and only about one run of words in fourteen is an anchor. ``places``: how often the anchor stands
    in the run, which is more than once where a text repeats itself at short distance.
    """
    grams, first = words.gram_hashes(anchor, hashes)
    inside = window - anchor + 1
    counts = np.maximum(np.diff(first) - inside + 1, 0)
    least, reach = grams, 1
    while reach < inside:
        step = min(reach, inside - reach)
        least = np.minimum(least[: max(0, least.size - step)], least[step:])
        reach += step
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    least = least[at]
    fresh = np.ones(least.size, bool)
    fresh[1:] = least[1:] != least[:-1]
    fresh[begin[:-1][counts > 0]] = True
    start = np.flatnonzero(fresh)
    text = np.searchsorted(begin, start, side="right") - 1
    n = np.diff(np.append(start, least.size))
    spread = n + inside - 1
    ends = np.cumsum(spread)
    within = np.arange(ends[-1] if ends.size else 0) + np.repeat(at[start] - (ends - spread), spread)
    same = grams[within] == np.repeat(least[start], spread)
    places = np.add.reduceat(same.astype(np.int64), ends - spread) if ends.size else ends
    return text, least[start].view(np.int64), start - begin[text], n, places


def _letters(segments: list[list[bytes]]) -> list[str]:
    """Each distinct word as one character."""
    codes: dict[bytes, str] = {}
    out = []
    for segment in segments:
        for word in segment:
            if word not in codes:
                n = len(codes) + 1
                codes[word] = chr(n if n < _SURROGATES else n + 0x800)
        out.append("".join(map(codes.__getitem__, segment)))
    return out


def recurring(groups: list[list[tuple[bytes, int]]], window: int) -> dict[bytes, list[tuple[int, int]]]:
    """Of segments grouped by anchor (words joined by spaces, and how often the segment occurs)
    the word ranges that stand in windows that occur more than once.

    First the windows of each group are counted. Runs of windows that recur are the phrases, which
    are compiled into an automaton with one letter per word. Then every segment is streamed
    through it, and each occurrence of a phrase is a range. A phrase consists of recurring windows
    only, and a segment's own phrases are among all phrases, so nothing is missed or added.
    """
    texts = list(dict.fromkeys(text for group in groups for text, _ in group))
    letters = dict(zip(texts, _letters([t.split(b" ") for t in texts])))
    phrases: set[str] = set()
    for group in groups:
        counts: Counter[str] = Counter()
        for text, times in group:
            line = letters[text]
            for at in range(len(line) - window + 1):
                counts[line[at : at + window]] += times
        for text, _ in group:
            line, start = letters[text], None
            for at in range(len(line) - window + 2):
                again = at <= len(line) - window and counts[line[at : at + window]] > 1
                if again and start is None:
                    start = at
                elif not again and start is not None:
                    phrases.add(line[start : at - 1 + window])
                    start = None
    found: dict[bytes, list[tuple[int, int]]] = {}
    if not phrases:
        return found
    automaton = ahocorasick.Automaton()
    for phrase in phrases:
        automaton.add_word(phrase, len(phrase))
    automaton.make_automaton()
    for text in texts:
        ranges: list[tuple[int, int]] = []
        for end, length in automaton.iter(letters[text]):
            a, b = end - length + 1, end + 1
            while ranges and a <= ranges[-1][1]:
                a = min(a, ranges.pop()[0])
            ranges.append((a, b))
        if ranges:
            found[text] = ranges
    return found


def _locate(window: int):
    """Task over segments sorted by anchor: automata for as many whole groups as fit a shard."""

    def ranges_of(rows):
        by_anchor: dict[int, Counter[bytes]] = {}
        for anchor, text, *_ in rows:
            by_anchor.setdefault(anchor, Counter())[text] += 1
        found = recurring([list(c.items()) for c in by_anchor.values()], window)
        out = [(k1, k2, start + a, start + b) for _, text, k1, k2, start in rows for a, b in found.get(text, ())]
        cols = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in cols], ["k1", "k2", "begin", "stop"]
        )

    def run(batches):
        held, words = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "k1", "k2", "start"))):
                if held and words >= SHARD_WORDS and row[0] != held[-1][0]:
                    yield ranges_of(held)
                    held, words = [], 0
                held.append(row)
                words += row[1].count(b" ") + 1
        if held:
            yield ranges_of(held)

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``k1, k2, begin, stop``: word ranges of repeated windows; ``docs`` has ``k1, k2, text``,
    keys that are equal for equal rows only. All its columns go through the join, so that a later
    join of the same rows by the same keys finds them shuffled already."""

    def anchors(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"), lower=False)
                text, name, start, n, places = anchor_runs(words, words.hashes(), window, anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name), part.column("k1").take(pa.array(text)), part.column("k2").take(pa.array(text)), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(places, pa.int32())],
                    ["anchor", "k1", "k2", "start", "windows", "places"],
                )

    runs, _ = freeze(docs.select("k1", "k2", "text").mapInArrow(anchors, "anchor bigint, k1 bigint, k2 bigint, start int, windows int, places int"))
    again, _ = freeze(runs.groupBy("anchor").agg(F.sum("places").alias("places"), F.count(F.lit(1)).alias("runs")).where("places > 1"))
    wanted = (
        runs.select("anchor", "k1", "k2", "start", "windows").join(again.select("anchor", (F.col("runs") > HOT_RUNS).alias("hot")), "anchor")
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("start", "windows", "anchor", "hot")).alias("runs"))
        .withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    )
    chosen = docs.join(wanted, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).select(*docs.columns, "runs")

    def segments(hot):
        def cut(batches):
            for batch in batches:
                for part in pieces(batch, "text"):
                    out = []
                    for k1, k2, text, runs in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "text", "runs"))):
                        words = text.encode("utf-8", "surrogatepass").split()
                        for run in runs:
                            s, n = run["start"], run["windows"]
                            if run["hot"] and hot:
                                for at in range(s, s + n):
                                    whole = hashlib.md5(b" ".join(words[at : at + window])).digest()
                                    out.append((run["anchor"], whole, k1, k2, at))
                            elif not run["hot"] and not hot:
                                out.append((run["anchor"], b" ".join(words[s : s + n + window - 1]), k1, k2, s))
                    cols = list(zip(*out)) or [[]] * 5
                    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["anchor", "segment", "k1", "k2", "start"])

        return cut

    schema = "anchor bigint, segment binary, k1 bigint, k2 bigint, start bigint"
    ranges = "k1 bigint, k2 bigint, begin bigint, stop bigint"
    parts = chosen.mapInArrow(segments(False), schema).repartition("anchor").sortWithinPartitions("anchor")
    found = parts.mapInArrow(_locate(window), ranges)
    if again.where(F.col("runs") > HOT_RUNS).limit(1).count():
        windows = chosen.mapInArrow(segments(True), schema)
        windows, _ = freeze(windows.select("segment", "k1", "k2", "start"))
        twice, _ = freeze(windows.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("segment"))
        hot = windows.join(twice, "segment").select("k1", "k2", F.col("start").alias("begin"), (F.col("start") + window).alias("stop"))
        found = found.unionByName(hot)
    return found


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_column: str = "doc_id") -> DataFrame:
    """Takes out every word that stands in a window of ``window`` words whose word sequence starts
    anywhere else too, in the same text or another one; all windows are judged on the input.

    ``docs`` has the id and ``text``; other columns are not read. Words stand between ASCII white
    space and are compared as they are. Returns one row per input row: the id, ``n_words``,
    ``n_removed`` and ``text``, the kept words joined by one space. A null text has no words and
    becomes the empty text. Exactly repeated rows repeat each other, so their windows go; ids may
    be null or repeat.

    Equal windows share an anchor, so windows meet by anchors: those that occur once are dropped
    at once, and only segments around the others move, to the shard of their anchor.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.xxhash64(F.col(id_column), text).alias("k1"), F.xxhash64(text, F.lit(1), F.col(id_column)).alias("k2"),
        F.col(id_column).alias("_id"), text.alias("text"),
    )
    ranges = (
        repeated_ranges(keyed, window, anchor)
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("begin", "stop")).alias("ranges"))
        .withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    )
    joined = keyed.join(ranges, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left").select("_id", "text", "ranges")

    def clean(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                out = []
                for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                    words = text.encode("utf-8", "surrogatepass").split()
                    kept, done = [], 0
                    for r in sorted(ranges or (), key=lambda r: r["begin"]):
                        kept += words[done : r["begin"]]
                        done = max(done, r["stop"])
                    kept += words[done:]
                    out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
                n, removed, texts = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                    ["_id", "n_words", "n_removed", "text"],
                )

    done = joined.mapInArrow(clean, f"_id {kind}, n_words bigint, n_removed bigint, text string")
    return done.withColumnRenamed("_id", id_column)
