"""Messy documents and plain versions of what the operators compute."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{n % 977} of{n % 13}" for n in range(20_000))
PASSAGE = " ".join(f"p{n}" for n in range(60))

#: Nulls in every column, empty and very long texts, ties, repeated rows and ids.
MESSY = [
    (0, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
    (2, None, "en", "b", None),
    (3, "", "de", "b", 0),
    (4, " \t\n ", None, "b", 4),
    (5, "123 456 !!", "en", None, 10),
    (None, "Kein Mensch muss das hier lesen, aber der Test liest es doch", "de", None, None),
    (None, None, None, None, None),
    (6, f"intro one {PASSAGE} outro", "en", "a", 9),
    (7, f"{PASSAGE} other end here <|endoftext|> \U0001f600", "en", "c", 9),
    (8, "x x x " * 40, "xx", "c", 9),
    (9, LONG, "en", "d", len(LONG)),
    (10, "one", "fr", "", 3),
    (11, "one", "fr", "", 3),
    (12, "THE quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
]


def documents(spark, rows=None):
    """With extra columns of names that operators use inside."""
    docs = spark.createDataFrame(MESSY if rows is None else rows, COLUMNS)
    clashing = ("_id", "_row", "k1", "k2", "row", "word", "words", "size", "label", "digest", "u", "bin", "_held", "host")
    return docs.select("*", *[F.lit(7).alias(c) for c in clashing])


def split(text):
    return (text or "").encode().split()


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def components(texts: dict):
    """Smallest key of every key's group of similar texts, by comparing all pairs that share."""
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    having = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            having[x].append(k)
    for k, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for other in having[x]:
                shared[other] += other > k
        for other, n in shared.items():
            if n and 100 * n >= 75 * (len(s) + len(sets[other]) - n):
                a, b = find(k), find(other)
                parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in sets}


def kept_words(texts: list, window: int = 35):
    """Words of every text that stand in no repeated window."""
    words = [split(t) for t in texts]
    seen = defaultdict(int)
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] += 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out
