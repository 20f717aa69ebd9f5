"""Language identification as inference of a mixture of languages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.arrays import Words, give_back, pieces
from lapsewise.llm.common import crc_mod

UNKNOWN = "und"
BITS = 16
#: The model has languages * 2 ** BITS numbers of four bytes; this bounds it to 256 MB.
MOST_LANGUAGES = 1_000
SMOOTHING = 0.5
EM_STEPS = 8
#: A further language must raise a document's log-likelihood by this times log(1 + words).
PENALTY = 3.0
#: Bytes of text worked on at once, which take some thirty times as much in arrays.
PIECE = 1 << 20
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # log-probabilities, language by n-gram bucket


def _buckets(words: Words) -> np.ndarray:
    """For every byte of a word the hashed 3-gram around it; a word is bounded by spaces."""
    b = words.data.astype(np.uint32)
    left, right = np.empty_like(b), np.empty_like(b)
    left[1:], right[:-1] = b[:-1], b[1:]
    left[words.start] = right[words.end - 1] = 0x20
    code = (left << np.uint32(16) | b << np.uint32(8) | right)[words.solid]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def learn(docs: DataFrame) -> Model:
    """n-gram counts of every row of ``docs`` (``text``, ``lang``) with a language.

    Each task adds up one array per language, so what is shuffled is bounded by languages and
    buckets, whatever the corpus holds; the collected model has the same bound.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in dict.fromkeys(langs):
                    grams = _buckets(Words(part.filter(pa.array(langs == lang)).column("text"), lower=True))
                    counts = np.bincount(grams, minlength=1 << BITS)
                    sums[lang] = sums.get(lang, 0) + counts
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * at.size, pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
                ["lang", "bucket", "n"],
            )
        give_back()

    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    counted = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; the model is bounded to {MOST_LANGUAGES}")
    table = np.zeros((len(names), 1 << BITS))
    at = {name: k for k, name in enumerate(names)}
    rows_of = np.array([at[x] for x in found.column("lang").to_pylist()], int)
    table[rows_of, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    table = np.log(table + SMOOTHING) - np.log(table.sum(1, keepdims=True) + SMOOTHING * (1 << BITS))
    return Model(tuple(names), table.astype(np.float32))


def _proportions(p: np.ndarray, start: np.ndarray, n: np.ndarray, steps: int = EM_STEPS):
    """Maximum-likelihood shares of each text, by EM. ``p``: languages by words, likelihoods
    relative to a word's best; words of text i begin at ``start[i]``, ``n[i]`` of them."""
    k = p.shape[0]
    shares = np.full((k, n.size), 1.0 / k)
    for _ in range(steps):
        joint = np.repeat(shares, n, axis=1)
        joint *= p
        total = joint.sum(0)
        joint /= total
        shares = np.stack([np.add.reduceat(row, start) for row in joint]) / n
    total = (np.repeat(shares, n, axis=1) * p).sum(0)
    return shares, np.add.reduceat(np.log(total), start)


def _select(p: np.ndarray, best: int, gain_needed: float) -> tuple[list[int], np.ndarray]:
    """Forward selection of languages for one text: add the language that helps most while the
    log-likelihood rises by more than the penalty."""
    n, zero = np.array([p.shape[1]]), np.array([0])
    chosen, reached = [best], float(np.log(p[best]).sum())
    shares = np.ones(1)
    while len(chosen) < p.shape[0]:
        tries = []
        for other in range(p.shape[0]):
            if other not in chosen:
                got, likelihood = _proportions(p[[*chosen, other]], zero, n)
                tries.append((float(likelihood[0]), -other, got[:, 0]))
        likelihood, other, got = max(tries, key=lambda t: t[:2])
        if likelihood - reached <= gain_needed:
            break
        chosen, reached, shares = [*chosen, -other], likelihood, got
    return chosen, shares


def infer(texts: pa.Array, model: Model) -> list[tuple[str, float, list[tuple[str, float]]]]:
    """For each text its language, a score, and its languages with their shares of the words."""
    words = Words(texts, lower=True)
    k = len(model.languages)
    some = np.flatnonzero(words.count) if k else np.zeros(0, int)
    readable = [x is not None and LETTER.search(x) is not None for x in texts.to_pylist()]
    out: list = [(UNKNOWN, 0.0, [])] * len(texts)
    if not some.size:
        return out
    grams = _buckets(words)
    ends = np.cumsum(words.end - words.start)
    scores = np.stack([np.add.reduceat(row[grams], ends - (words.end - words.start)) for row in model.table]).astype(np.float64)
    n, start = words.count[some], words.first[:-1][some]
    alone = np.stack([np.add.reduceat(row, start) for row in scores])
    best = alone.argmax(0)
    peak = scores.max(0)
    p = np.maximum(np.exp(scores - peak), 1e-30)
    shares, mixed = _proportions(p, start, n)
    single = np.add.reduceat(np.log(p[np.repeat(best, n), np.arange(p.shape[1])]), start)
    needed = PENALTY * np.log1p(n)
    # No set can beat the mixture of all languages, so most texts are settled here.
    open_ = mixed - single > needed
    for j, text in enumerate(some):
        if not readable[text]:
            continue
        if open_[j]:
            chosen, found = _select(p[:, start[j] : start[j] + n[j]], int(best[j]), float(needed[j]))
        else:
            chosen, found = [int(best[j])], np.ones(1)
        top = max(range(len(chosen)), key=lambda c: (found[c], -chosen[c]))
        share = min(1.0, max(0.0, float(shares[chosen[top], j])))
        score = (n[j] * share + 1) / (n[j] + k)
        parts = sorted(zip((model.languages[c] for c in chosen), map(float, found)), key=lambda x: (-x[1], x[0]))
        out[text] = (model.languages[chosen[top]], float(score), parts)
    return out


def identify(
    docs: DataFrame, id_column: str = "doc_id", folds: int = 4, held_out: int = 2
) -> DataFrame:
    """The languages of every row of ``docs`` (id, ``text``, ``lang``; other columns are not read).

    Learns from the rows with a text and a language whose crc32 of the id as text, modulo
    ``folds``, is not ``held_out`` (a null id is learned from); nothing but the text is an input
    of a prediction. Returns one row per input row: the id, ``held_out``, ``lang_pred`` (a learned
    language, or ``und`` where the text is null or without a letter, or nothing was learned),
    ``score`` (0 to 1: the language's share of the words, smoothed towards even shares for short
    texts) and ``languages`` (the selected set with shares). Ties go to the first language by
    name; repeated rows get equal results.

    A word's likelihood in a language comes from its 3-grams of bytes. EM estimates the shares of
    the languages over a whole text's words; a language joins a text's set only if the
    log-likelihood grows by more than the penalty.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.col(id_column).alias("_id"), F.col("text"), F.col("lang"),
        (crc_mod(F.col(id_column), folds) == held_out).alias("_held"),
    )
    model = learn(keyed.where(~F.col("_held")))
    shared = spark.sparkContext.broadcast((model.languages, model.table))
    kind = docs.schema[id_column].dataType.simpleString()

    def predict(batches):
        known = Model(*shared.value)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                found = infer(part.column("text"), known)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        part.column("_held"),
                        pa.array([x[0] for x in found], pa.string()),
                        pa.array([x[1] for x in found], pa.float64()),
                        pa.array([x[2] for x in found], pa.map_(pa.string(), pa.float64())),
                    ],
                    ["_id", "held_out", "lang_pred", "score", "languages"],
                )
        give_back()

    schema = f"_id {kind}, held_out boolean, lang_pred string, score double, languages map<string,double>"
    return keyed.select("_id", "_held", "text").mapInArrow(predict, schema).withColumnRenamed("_id", id_column)


def keep_identified(
    docs: DataFrame, least: float = 0.3, id_column: str = "doc_id", folds: int = 4, held_out: int = 2
) -> DataFrame:
    """``docs`` with all its columns, without the rows whose language stays unknown or whose main
    language has less than ``least`` of the words, which are jumbles of four languages or more.
    Learns as ``identify`` does; repeated rows are judged alike."""
    keyed = docs.select("text", "lang", (crc_mod(F.col(id_column), folds) == held_out).alias("_held"))
    model = learn(keyed.where(~F.col("_held")))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))

    def keep(batches):
        known = Model(*shared.value)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                found = infer(part.column("text"), known)
                yield part.filter(pa.array([x[0] != UNKNOWN and x[2][0][1] >= least for x in found], pa.bool_()))
        give_back()

    return docs.mapInArrow(keep, docs.schema)
