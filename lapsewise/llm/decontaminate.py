"""Benchmark passages in documents: a broadcast set of normalised n-grams, scanned and verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import ascii_lower
from lapsewise.session import freeze

#: What parts words before lower-casing: ASCII other than digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: n-grams that are broadcast; more meet the documents in a shuffled join.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Words in their original case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def _grams(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct windows of ``n`` lower-case words with their items. An item with fewer words is
    one window. ``anchor``: the longest word of a window, as long words are rare ones."""
    items = benchmark.select(
        F.col("item_id"), F.transform(words_of(F.col("text")), ascii_lower).alias("words")
    ).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    windows = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, n))).alias("gram"))
    found = windows.groupBy("gram").agg(F.collect_set("item_id").alias("items"))
    longest = F.array_max(F.transform("gram", lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    return found.select(
        "gram",
        "items",
        longest.alias("anchor"),
        (F.array_position("gram", longest) - 1).cast("int").alias("before"),
        F.size("gram").alias("length"),
    )


def _hits(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """``_id, _hash, start, length, items``: every occurrence of a window, verified word by word."""
    grams, count = freeze(_grams(benchmark, n))
    # Windows of one anchor together, so that the side that is looked up has few rows for a word.
    by_anchor = grams.groupBy("anchor").agg(
        F.collect_list(F.struct("before", "length", "gram", "items")).alias("windows")
    )
    if count <= BROADCAST_ROWS:
        by_anchor = F.broadcast(by_anchor)
    scanned = docs.select("_id", "_hash", words_of(F.col("text")).alias("words")).select(
        "_id", "_hash", "words", F.posexplode("words").alias("at", "word")
    )
    met = scanned.withColumn("anchor", ascii_lower(F.col("word"))).join(by_anchor, "anchor")
    near = F.filter(
        "windows",
        lambda w: (F.col("at") >= w["before"])
        & (F.transform(F.slice("words", F.greatest(F.col("at") - w["before"] + 1, F.lit(1)), w["length"]), ascii_lower) == w["gram"]),
    )
    return met.select("_id", "_hash", "at", F.explode(near).alias("w")).select(
        "_id", "_hash", (F.col("at") - F.col("w.before")).alias("start"), F.col("w.length").alias("length"),
        F.col("w.items").alias("items"),
    )


def _keyed(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("_id"), F.xxhash64("text").alias("_hash"), F.col("text")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_column: str = "doc_id") -> DataFrame:
    """How much of every document stands in ``benchmark`` (``item_id``, ``text``).

    Words are runs of digits, A-Z lower-cased, and anything beyond ASCII. A document word inside
    any occurrence of a window of ``n`` item words is hit. Returns one row per input row:
    the id, ``n_words, n_hit, n_items, items`` (ids as strings, sorted), ``contaminated``. A null
    or empty text has no words and no hits; repeated rows get equal results; a null id is kept; a
    null item id hits without being listed; an empty benchmark hits nothing. Other columns are not
    read, so their names do not matter.

    One scan explodes words inside generated code and looks each up in the anchors of the windows;
    windows around the few that match are then compared word by word. The windows are broadcast
    up to ``BROADCAST_ROWS``, a counted number; a larger benchmark is joined by shuffling.
    """
    keyed = _keyed(docs, id_column)
    hits = _hits(keyed, benchmark, n)
    # Windows overlap heavily, so a document's hits are reduced to one row before they are opened.
    found = hits.groupBy("_id", "_hash").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("items").alias("items")
    )
    positions = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    found = found.select(
        F.col("_id").alias("_hit_id"),
        F.col("_hash").alias("_hit_hash"),
        F.size(F.array_distinct(positions)).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform(F.flatten("items"), lambda i: i.cast("string")))).alias("items"),
    )
    counts = keyed.select("_id", "_hash", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    same = F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_hash") == F.col("_hit_hash"))
    none = F.array().cast("array<string>")
    return counts.join(found, same, "left").select(
        F.col("_id").alias(id_column),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with all its columns, without the rows that hold a window of the benchmark."""
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_column).alias("_id"), F.xxhash64("text").alias("_hash"))
    hits = _hits(_keyed(docs, id_column), benchmark, n).select("_id", "_hash").distinct()
    hits = hits.select(F.col("_id").alias("_hit_id"), F.col("_hash").alias("_hit_hash"))
    same = F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_hash") == F.col("_hit_hash"))
    return keyed.join(hits, same, "left_anti").select("_row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with all its columns, hit words taken out of ``text``.

    A text with hits becomes its other words in their order, each run of them on a line of its
    own, so that no new window arises across a removed span; other texts stay as they are.
    """
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_column).alias("_id"), F.xxhash64("text").alias("_hash"))
    spans = (
        _hits(_keyed(docs, id_column), benchmark, n)
        .groupBy("_id", "_hash")
        .agg(F.collect_set(F.struct("start", "length")).alias("_spans"))
        .select(F.col("_id").alias("_hit_id"), F.col("_hash").alias("_hit_hash"), "_spans")
    )
    same = F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_hash") == F.col("_hit_hash"))
    hit = F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    words = F.col("_words")
    kept = F.transform(
        words, lambda w, i: F.when(F.array_contains(F.col("_hit"), i), F.lit("\n")).otherwise(w)
    )
    text = F.trim(F.regexp_replace(F.array_join(kept, " "), r" ?\n( ?\n)* ?", "\n"))
    joined = keyed.join(spans, same, "left").select(
        "_row", "_spans", F.array_distinct(hit).alias("_hit"), words_of(F.col("_row.text")).alias("_words")
    )
    cleaned = F.when(F.col("_spans").isNull(), F.col("_row.text")).otherwise(text)
    return joined.select(
        *[(cleaned if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns]
    )
