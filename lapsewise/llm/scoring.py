"""Language-model scores of documents by a log-bilinear model."""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import crc_mod
from lapsewise.session import freeze

#: Words that are looked up in each task, all others in a join: at most so many, of so many bytes.
HEAD_WORDS, HEAD_BYTES = 131_072, 64
#: Output units of the model: the most frequent words, classes of the other words, the end.
FREQUENT, CLASSES = 767, 256
END = FREQUENT + CLASSES
UNITS = END + 1
DIMENSIONS = 16
NOISE = 24
BATCH = 512
RATE = 0.1
#: Shards by their number modulo ROUND_SHARDS in the rounds of training; each stands in one.
ROUND_SHARDS, ROUNDS = 8, ((0,), (1, 2), (3, 4, 5, 6, 7))
#: Shards of the training texts at most; beyond, a shard has several pieces.
MOST_SHARDS = 65_536
#: Parameters are added up as whole multiples of 1 / SCALE.
SCALE = float(1 << 20)
#: Words a task counts before it hands its counts on.
COUNTER_WORDS = 500_000
PIECE_WORDS = 1 << 20


def word_class(word: bytes) -> int:
    """Class of a word that is no unit of its own, by its last two bytes."""
    return FREQUENT + zlib.crc32(word[-2:]) % CLASSES


def _class_column(word: Column) -> Column:
    return F.crc32(F.substring(word, -2, 2)) % CLASSES + FREQUENT


def _tokens(text: str | None) -> list[bytes]:
    """``bytes.split`` parts words at the six ASCII white spaces and ``bytes.lower`` changes A-Z
    only, which is what the tokens are."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (binary), ``n``: counts over every text, added up in tasks before they move."""

    def count(batches):
        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(_tokens(text.as_py()))
                if len(counts) > COUNTER_WORDS:
                    yield rows()
                    counts = Counter()
        if counts:
            yield rows()

    return docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """Words with the highest counts, at most ``most``: a threshold from a histogram of rounded
    logarithms, whose size is bounded, so that nothing is sorted."""
    step = F.floor(F.log2("n") * 64)
    short = counts.where(F.octet_length("word") <= HEAD_BYTES).withColumn("step", step)
    histogram = sorted((r["step"], r["words"]) for r in short.groupBy("step").agg(F.count(F.lit(1)).alias("words")).collect())
    least, room = 1 << 40, most
    for at, words in reversed(histogram):
        if words > room:
            break
        least, room = at, room - words
    return short.where(F.col("step") >= least).select("word", "n")


class Head:
    """What every task knows: frequent words with counts and units."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.known = {w: k for k, w in enumerate(words)}
        units = [k if k < FREQUENT else word_class(w) for k, w in enumerate(words)]
        self.counts, self.units = counts, np.array(units, np.int32)


def _unit_streams(texts, head: Head):
    """Per text the unit of every token with the end last, and the places of the known words."""
    known = head.known
    for text in texts:
        words = _tokens(text)
        yield words, np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))


def _units(words: list[bytes], at: np.ndarray, head: Head) -> np.ndarray:
    units = np.empty(at.size + 1, np.int32)
    units[:-1] = head.units[at] if head.units.size else 0
    for k in np.flatnonzero(at < 0):
        units[k] = word_class(words[k])
    units[-1] = END
    return units


def _contexts(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last and the last but one unit before each; the end stands before the first."""
    one, two = np.full(units.size, END, np.int32), np.full(units.size, END, np.int32)
    one[1:], two[2:] = units[:-1], units[:-2]
    return one, two


def _scatter(target: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """target[at] += values, added up by sorting."""
    order = np.argsort(at, kind="stable")
    keys = at[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    target[keys[starts]] += np.add.reduceat(values[order], starts, axis=0)


class LogBilinear:
    """Score of unit w after units v1 (last) and v2: ``(a1 * R[v1] + a2 * R[v2]) . Q[w] + b[w]``."""

    def __init__(self, r, q, a, b):
        self.r, self.q, self.a, self.b = r, q, a, b

    @classmethod
    def start(cls, unigram: np.ndarray):
        rng = np.random.default_rng(7)
        # With no target vectors yet the model is the unigram, from which training departs.
        r = rng.normal(0, 0.3, (UNITS, DIMENSIONS))
        q = np.zeros((UNITS, DIMENSIONS))
        return cls(r, q, np.ones((2, DIMENSIONS)) * [[1.0], [0.5]], np.log(unigram))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.r.ravel(), self.q.ravel(), self.a.ravel(), self.b])

    @classmethod
    def unflat(cls, x: np.ndarray):
        k = UNITS * DIMENSIONS
        d = 2 * DIMENSIONS
        return cls(
            x[:k].reshape(UNITS, DIMENSIONS).copy(), x[k : 2 * k].reshape(UNITS, DIMENSIONS).copy(),
            x[2 * k : 2 * k + d].reshape(2, DIMENSIONS).copy(), x[2 * k + d :].copy(),
        )

    def learn(self, units: np.ndarray, one: np.ndarray, two: np.ndarray, noise: np.ndarray, squares, rng) -> None:
        """One pass of noise-contrastive estimation: tell each unit from ``NOISE`` units drawn for
        the whole batch. AdaGrad steps, the gradient of a batch taken as a mean."""
        cumulated = np.cumsum(noise)
        log_noise = np.log(noise * NOISE).astype(np.float32)
        values = [x.astype(np.float32) for x in (self.r, self.q, self.a, self.b)]
        r, q, a, bias = values
        for s in range(0, units.size, BATCH):
            w, v1, v2 = units[s : s + BATCH], one[s : s + BATCH], two[s : s + BATCH]
            n = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), UNITS - 1)
            r1, r2, qw = r[v1], r[v2], q[w]
            context = r1 * a[0] + r2 * a[1]
            real = np.einsum("ij,ij->i", context, qw) + (bias - log_noise)[w]
            drawn = context @ q[n].T + (bias - log_noise)[n]
            miss = 1 / (1 + np.exp(np.clip(real, -30, 30)))
            wrong = -1 / (1 + np.exp(np.clip(-drawn, -30, 30)))
            back = miss[:, None] * qw + wrong @ q[n]
            gq, gb, gr = np.zeros_like(q), np.bincount(w, miss, UNITS).astype(np.float32), np.zeros_like(r)
            _scatter(gq, w, miss[:, None] * context)
            np.add.at(gq, n, wrong.T @ context)
            np.add.at(gb, n, wrong.sum(0))
            _scatter(gr, np.concatenate([v1, v2]), np.concatenate([back * a[0], back * a[1]]))
            ga = np.stack([(back * r1).sum(0), (back * r2).sum(0)])
            for value, gradient, square in zip(values, (gr, gq, ga, gb), squares):
                gradient /= w.size
                square += gradient * gradient
                value += RATE * gradient / np.sqrt(square + 1e-10)
        self.r, self.q, self.a, self.b = (x.astype(np.float64) for x in values)

    def tables(self):
        """``A[v1, w]`` and ``B[v2, w]``, whose sum is the score, and the logarithm of the
        normaliser for every context, all by matrix products."""
        first = (self.r * self.a[0]) @ self.q.T + self.b
        second = (self.r * self.a[1]) @ self.q.T
        top1, top2 = first.max(1, keepdims=True), second.max(1, keepdims=True)
        total = np.exp(first - top1) @ np.exp(second - top2).T
        z = np.log(np.maximum(total, 1e-300)) + top1 + top2.T
        return first.astype(np.float32), second.astype(np.float32), z.astype(np.float32)


def _pieces(docs: DataFrame, shared_head, tokens: int) -> DataFrame:
    """The texts as unit streams, ``shard, piece, units`` (16 bits each, texts one after the other).

    A text's shard is a hash of id and text, and texts stand in the order of that hash; a shard has
    about ``PIECE_WORDS`` units, and a larger one several pieces. So the pieces are the same
    whatever the partitions of ``docs``.
    """

    def units_of(batches):
        head = Head(*shared_head.value)
        for batch in batches:
            streams = [_units(words, at, head).astype(np.uint16).tobytes() for words, at in _unit_streams(batch.column(2).to_pylist(), head)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(streams, pa.binary())], ["shard", "key", "units"])

    key = F.xxhash64("_id", "text")
    shards = min(MOST_SHARDS, 1 + 4 * tokens // (3 * PIECE_WORDS))
    rows = docs.select(F.pmod(key, F.lit(shards)).alias("shard"), key.alias("key"), "text").mapInArrow(
        units_of, "shard bigint, key bigint, units binary"
    )

    def pack(batches):
        held: list[bytes] = []
        size, at, piece = 0, None, 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([piece], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["shard", "piece", "units"]
            )

        for batch in batches:
            for shard, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (shard != at or size >= PIECE_WORDS):
                    yield row()
                    piece = piece + 1 if shard == at else 0
                    held, size = [], 0
                at = shard
                held.append(units)
                size += len(units) // 2
        if held:
            yield row()

    # Equal keys are equal texts, but for a collision; then the units decide.
    ordered = rows.repartition("shard").sortWithinPartitions("shard", "key", "units")
    return freeze(ordered.select("shard", "units").mapInArrow(pack, "shard bigint, piece bigint, units binary"))[0]


def _train(pieces: DataFrame, unigram: np.ndarray) -> LogBilinear:
    """Parameters averaged over pieces, weighted by tokens: the pieces of a round all start from the
    average of the round before, parameters and step sizes, and every piece is passed over once.
    Sums are whole numbers, so they do not depend on their order."""
    spark = pieces.sparkSession
    model = LogBilinear.start(unigram)
    steps = np.zeros(model.flat().size)
    for shards in ROUNDS:
        sent = spark.sparkContext.broadcast((model.flat(), steps, unigram))

        def fit(batches, sent=sent):
            flat, steps, noise = sent.value
            total, seen = np.zeros(2 * flat.size, np.int64), 0
            for batch in batches:
                for shard, piece, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    units = np.frombuffer(data, np.uint16).astype(np.int32)
                    one, two = _contexts(units)
                    # A text's end is the context before the next text, so no context crosses it.
                    two[np.flatnonzero(units[:-1] == END) + 1] = END
                    mine, sizes = LogBilinear.unflat(flat), LogBilinear.unflat(steps)
                    squares = [(x * x).astype(np.float32) for x in (sizes.r, sizes.q, sizes.a, sizes.b)]
                    rng = np.random.default_rng([shard, piece])
                    order = rng.permutation(units.size)
                    mine.learn(units[order], one[order], two[order], noise, squares, rng)
                    done = np.concatenate([mine.flat(), *(np.sqrt(x.astype(np.float64)).ravel() for x in squares)])
                    total += np.rint(done * (SCALE * units.size)).astype(np.int64)
                    seen += units.size
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(total.size), pa.int32()), pa.array(total), pa.array(np.full(total.size, seen))], ["at", "value", "weight"]
                )

        mine = pieces.where((F.col("shard") % ROUND_SHARDS).isin(*shards))
        sums = mine.mapInArrow(fit, "at int, value bigint, weight bigint").groupBy("at").agg(
            F.sum(F.col("value").cast("decimal(38,0)")).cast("double").alias("value"), F.sum("weight").alias("weight")
        )
        found = sums.toArrow()
        both = np.concatenate([model.flat(), steps])
        both[found.column("at").to_numpy()] = found.column("value").to_numpy() / (SCALE * found.column("weight").to_numpy())
        model, steps = LogBilinear.unflat(both[: steps.size]), both[steps.size :]
    return model


def score(docs: DataFrame, id_column: str = "doc_id", folds: int = 7, held_out: int = 2) -> DataFrame:
    """Log10 probabilities of every row's whole text (id, ``text``; other columns are not read).

    Tokens are words between ASCII white space, A-Z lower-cased, and one end per text; a null text
    is empty and has the end only. Learns from the rows whose crc32 of the id as text, modulo
    ``folds``, is not ``held_out`` (a null id is learned from). Returns one row per input row: the
    id, ``held_out, n_tokens, n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (add-one unigram) and ``score`` (the model). Repeated rows get equal scores; if
    nothing is learned from, all counts are 0 and units are equally likely.

    The model predicts units: the most frequent words, classes of all others, and the end. A word
    of a class has, within it, its add-one share of the class's training tokens; a word never seen
    has the share of one unseen word. So the probabilities of a class's words and of one unseen
    word add up to 1, as in the base.

    Counts of frequent words, a bounded number of bounded length, are known to every task; other
    words meet their counts in a join. All training rows are counted and trained on.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    keyed = docs.select(
        F.col(id_column).alias("_id"), F.col("text"), (crc_mod(F.col(id_column), folds) == held_out).alias("_held")
    )
    training = keyed.where(~F.col("_held"))
    counts, _ = freeze(count_words(training))
    ends = training.count()
    head_rows = _frequent(counts, HEAD_WORDS).toArrow()
    order = sorted(zip((-n for n in head_rows.column("n").to_pylist()), head_rows.column("word").to_pylist()))
    words = [w for _, w in order]
    head_counts = np.array([-n for n, _ in order], np.int64)
    # Tokens and words of every class, without the words that are units themselves.
    by_class = counts.groupBy(_class_column(F.col("word")).cast("int").alias("unit")).agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")
    )
    class_tokens, class_words = np.zeros(UNITS, np.int64), np.zeros(UNITS, np.int64)
    for r in by_class.collect():
        class_tokens[r["unit"]], class_words[r["unit"]] = r["tokens"], r["words"]
    total_words, total_tokens = int(class_words.sum()) + (ends > 0), int(class_tokens.sum()) + ends
    unigram = np.zeros(UNITS)
    for k, w in enumerate(words[:FREQUENT]):
        class_tokens[word_class(w)] -= head_counts[k]
        class_words[word_class(w)] -= 1
        unigram[k] = head_counts[k]
    unigram[FREQUENT:END] = class_tokens[FREQUENT:END]
    unigram[END] = ends
    unigram = (unigram + 1) / (unigram + 1).sum()
    class_total = np.log10(class_tokens + class_words + 1.0)
    base_total = float(np.log10(total_tokens + total_words + 1.0))
    shared_head = spark.sparkContext.broadcast((words, head_counts))
    model = _train(_pieces(training, shared_head, total_tokens), unigram)
    shared = spark.sparkContext.broadcast((*model.tables(), class_total, ends))

    def look(batches):
        head = Head(*shared_head.value)
        first, second, z, class_log, end_count = shared.value
        within = np.log10(head.counts + 1.0)
        in_class = head.units >= FREQUENT
        cost = np.where(in_class, within - class_log[head.units], 0.0) if head.units.size else within
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("row", "word", "times", "id", "held", "tokens", "known", "base", "score")}
            for doc, held, text in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                found, at = next(_unit_streams([text], head))
                units = _units(found, at, head)
                one, two = _contexts(units)
                logs = (first[one, units].astype(np.float64) + second[two, units] - z[one, two]) / np.log(10)
                here = at[at >= 0]
                rare = Counter(found[k] for k in np.flatnonzero(at < 0))
                known, base, total = here.size, float(within[here].sum()), float(logs.sum())
                if here.size:
                    total += float(cost[here].sum())
                for word, times in rare.items():
                    total -= times * class_log[word_class(word)]
                known += end_count > 0
                base += float(np.log10(end_count + 1.0))
                for key, values in zip(out, (row, None, 0, doc.as_py(), held.as_py(), units.size, int(known), base, total)):
                    out[key].append(values)
                for word, times in rare.items():
                    for key, values in zip(out, (row, word, times, None, None, None, None, None, None)):
                        out[key].append(values)
                row += 1
            kinds = (pa.int64(), pa.binary(), pa.int32(), batch.column(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    looked = keyed.select("_id", "_held", "text").mapInArrow(
        look,
        f"row bigint, word binary, times int, id {kind}, held boolean, tokens bigint, known bigint, base double, score double",
    )
    # A row's own line has no word; a key that no word can have keeps such lines apart from each other.
    key = F.coalesce(F.col("word"), F.concat(F.lit(" "), F.col("row").cast("string")).cast("binary"))
    rare_counts = counts.select(F.col("word").alias("_word"), F.col("n"))
    times, n = F.col("times"), F.coalesce("n", F.lit(0))
    joined = looked.withColumn("word", key).join(rare_counts, F.col("word") == F.col("_word"), "left")
    gained = F.when(times > 0, times * F.log10(n + 1.0))
    per_row = joined.groupBy("row").agg(
        F.max("id").alias(id_column),
        F.max("held").alias("held_out"),
        F.max("tokens").alias("n_tokens"),
        (F.max("known") + F.coalesce(F.sum(F.when(n > 0, times)), F.lit(0))).cast("bigint").alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(gained), F.lit(0.0))).alias("_base"),
        (F.max("score") + F.coalesce(F.sum(gained), F.lit(0.0))).alias("score"),
    )
    return per_row.select(
        id_column, "held_out", "n_tokens", "n_known", F.lit(total_tokens).cast("bigint").alias("train_tokens"),
        (F.col("_base") - F.col("n_tokens") * F.lit(base_total)).alias("base_score"), "score",
    )
