"""Token ids of documents in a compressed binary table (Re-Pair grammars)."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lapsewise.llm.arrays import _BYTE, SPACE, give_back, pieces, run_hashes
from lapsewise.session import work_path

MAGIC = b"RPG1"
END_ID = 2
#: Ids of a block, about; a block holds whole documents and has a grammar of its own.
BLOCK_IDS = 1 << 20
#: Terminal symbols: token ids below this, then the mark that ends a document.
TERMINALS = 51_200
MARK = TERMINALS
#: Pairs that a round replaces at most, and how often a pair must occur: a rule takes the room of
#: four symbols, so that fewer would not pay.
ROUND_PAIRS, LEAST = 16_384, 8
#: Bytes of chunks, ids and hashes that a task remembers.
KNOWN_BYTES = 96 << 20
#: Chunks that are encoded as one text.
JOINED = 128
ASCII_LETTER, ASCII_MARK = np.zeros(256, bool), np.zeros(256, bool)
ASCII_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
# Not the apostrophe, which the tokenizer may keep with letters after it.
ASCII_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
# White space beyond ASCII, and the vocabulary's own special text: such texts are encoded whole.
UNUSUAL = regex.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The bytes that its characters begin with in UTF-8.
RARE = b"\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3"


def _gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the runs ``start[i] .. start[i] + length[i]``, one run after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(start - (ends - length), length)


class _Runs:
    """A growing array of runs: run i is ``flat[begin[i] : begin[i + 1]]``."""

    def __init__(self, kind):
        self.flat, self.begin = np.zeros(1 << 16, kind), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        used = int(self.begin[-1])
        if used + flat.size > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros(max(self.flat.size // 2, flat.size), self.flat.dtype)])
        self.flat[used : used + flat.size] = flat
        self.begin = np.concatenate([self.begin, used + np.cumsum(lengths)])

    def places(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of some runs."""
        length = self.begin[runs + 1] - self.begin[runs]
        return _gather(self.begin[runs], length), length


class Encoder:
    """Encodes texts by the chunks they consist of: white space and what follows up to the next
    white space, parted between an ASCII letter and a mark. The tokenizer never joins text across
    the start of a chunk, so a chunk's ids are the same everywhere, and each distinct chunk is
    encoded once. Chunks are found by a hash and compared byte by byte."""

    def __init__(self, model: str):
        # Spark runs a task for each core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(model)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        # Tokens are written in an alphabet of one character a byte.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.chunks, self.ids = _Runs(np.uint8), _Runs(np.uint16)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, flat: np.ndarray, length: np.ndarray) -> None:
        """Keep new chunks, which stand one after the other in ``flat``, and their ids."""
        end = np.cumsum(length)
        begin = end - length
        plain = SPACE[flat[begin]] & ~SPACE[flat[end - 1]]
        for some, together in ((plain, JOINED), (~plain, 1)):
            chosen = np.flatnonzero(some)
            if not chosen.size:
                continue
            data, lengths = flat[_gather(begin[chosen], length[chosen])], length[chosen]
            ends = np.cumsum(lengths)
            cuts = [0, *ends[together - 1 :: together].tolist()]
            cuts += [] if cuts[-1] == data.size else [data.size]
            found = self._whole([data[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:])])
            ids = np.concatenate(found)
            # No token crosses the start of a chunk, so the last byte of a chunk ends a token.
            upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="left") + 1
            self.chunks.add(data, lengths)
            self.ids.add(ids, np.diff(upto, prepend=0))

    def _odd(self, text: str, data: bytes) -> bool:
        # All unusual white space has one of few bytes, so most texts need no closer look.
        if len(data) != len(data.translate(None, RARE)) and UNUSUAL.search(text):
            return True
        return any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        data = [t.encode() for t in texts]
        odd = [self._odd(t, d) for t, d in zip(texts, data)]
        out: list = [None] * len(texts)
        whole = [k for k, o in enumerate(odd) if o]
        for k, ids in zip(whole, self._whole([texts[k] for k in whole])):
            out[k] = ids
        usual = [k for k, o in enumerate(odd) if not o]
        for k, ids in zip(usual, self._by_chunks([data[k] for k in usual])):
            out[k] = ids
        return out

    def _by_chunks(self, texts: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not data.size:
            return [np.zeros(0, np.uint16)] * len(texts)
        space = SPACE[data]
        first = np.zeros(data.size, bool)
        first[1:] = (space[1:] & ~space[:-1]) | (ASCII_MARK[data[1:]] & ASCII_LETTER[data[:-1]])
        bounds = np.cumsum(sizes)
        first[(bounds - sizes)[sizes > 0]] = True
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, data.size))
        hashes, sample, which = np.unique(run_hashes(_BYTE[data], start, start + length), return_index=True, return_inverse=True)
        if self.chunks.flat.nbytes + self.ids.flat.nbytes + 32 * self.known.size > KNOWN_BYTES:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        old = at < self.hashes.size
        old[old] = self.hashes[at[old]] == hashes[old]
        number = np.empty(hashes.size, np.int64)
        number[old] = self.known[at[old]]
        new = np.flatnonzero(~old)
        if new.size:
            # In the order in which they are kept: plain ones first.
            begin = start[sample[new]]
            plain = SPACE[data[begin]] & ~SPACE[data[begin + length[sample[new]] - 1]]
            new = np.concatenate([new[plain], new[~plain]])
            number[new] = self.known.size + np.arange(new.size)
            self._learn(data[_gather(start[sample[new]], length[sample[new]])], length[sample[new]])
            order = np.sort(new)
            self.hashes, self.known = np.insert(self.hashes, at[order], hashes[order]), np.insert(self.known, at[order], number[order])
        number = number[which]
        # The hash only finds equal chunks; that they are equal is compared.
        places, lengths = self.chunks.places(number)
        if (lengths != length).any() or (self.chunks.flat[places] != data).any():
            return self._whole([t.decode() for t in texts])
        places, lengths = self.ids.places(number)
        ids = self.ids.flat[places]
        ends = np.cumsum(lengths)
        cuts = np.append(ends - lengths, ends[-1])[np.searchsorted(start, np.append(0, bounds))]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def compress(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: the sequence (16-bit symbols) with its frequent pairs replaced, and the rules, two symbols each.

    A round counts all pairs that do not touch a document's end, in a run of one symbol every
    second one, and takes the most frequent of them in which no symbol is a left and a right side
    at once; so occurrences never overlap and all are replaced together. Rounds go on until no
    pair occurs ``LEAST`` times or all names are given.
    """
    left: list[int] = []
    right: list[int] = []
    while True:
        a, b = sequence[:-1], sequence[1:]
        usable = (a != MARK) & (b != MARK)
        twin = np.flatnonzero(a == b)
        if twin.size:
            # Place of a twin in its run of neighbouring twins: only even ones count.
            run = np.flatnonzero(np.diff(twin, prepend=-2) > 1)
            usable[twin[(np.arange(twin.size) - np.repeat(run, np.diff(np.append(run, twin.size)))) % 2 == 1]] = False
        # Two symbols of 16 bits in one number of 32, which sorts fast.
        codes = (a.astype(np.uint32) << np.uint32(16) | b)[usable]
        codes.sort()
        at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if codes.size else np.zeros(0, int)
        counts = np.diff(np.append(at, codes.size))
        often = np.flatnonzero(counts >= LEAST)
        often = often[np.argsort(-counts[often], kind="stable")][:ROUND_PAIRS]
        lefts: set[int] = set()
        rights: set[int] = set()
        chosen = []
        for code in codes[at[often]].tolist():
            x, y = code >> 16, code & 0xFFFF
            if x not in rights and y not in lefts and (x != y or x not in lefts and x not in rights):
                lefts.add(x)
                rights.add(y)
                chosen.append(code)
        chosen = chosen[: (1 << 16) - TERMINALS - 1 - len(left)]
        if not chosen:
            break
        names = np.arange(len(chosen)) + TERMINALS + 1 + len(left)
        left += [c >> 16 for c in chosen]
        right += [c & 0xFFFF for c in chosen]
        order = np.argsort(chosen)
        table, names = np.array(chosen, np.uint32)[order], names[order].astype(np.uint16)
        is_left, is_right = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        is_left[list(lefts)], is_right[list(rights)] = True, True
        spots = np.flatnonzero(is_left[a] & is_right[b] & usable)
        wanted = sequence[spots].astype(np.uint32) << np.uint32(16) | sequence[spots + 1]
        found = np.minimum(np.searchsorted(table, wanted), table.size - 1)
        hit = table[found] == wanted
        spots, found = spots[hit], found[hit]
        sequence = sequence.copy()
        sequence[spots] = names[found]
        keep = np.ones(sequence.size, bool)
        keep[spots + 1] = False
        sequence = sequence[keep]
    return sequence, np.array([left, right], np.int32).reshape(2, -1)


def _expansions(rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every rule's terminals, one after the other, and where each begins."""
    texts: list[np.ndarray] = []

    def of(symbol: int) -> np.ndarray:
        return texts[symbol - TERMINALS - 1] if symbol > MARK else np.array([symbol], np.int32)

    for x, y in rules.T.tolist():
        texts.append(np.concatenate([of(x), of(y)]))
    return np.concatenate([np.zeros(0, np.int32), *texts]), np.cumsum([0, *(t.size for t in texts)])


def _expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    flat, begin = _expansions(rules)
    # Terminals stand before the rules in one table.
    table = np.concatenate([np.arange(MARK + 1, dtype=np.int32), flat])
    starts = np.concatenate([np.arange(MARK + 1), begin[:-1] + MARK + 1])
    lengths = np.concatenate([np.ones(MARK + 1, int), np.diff(begin)])[symbols]
    ends = np.cumsum(lengths)
    return table[np.arange(ends[-1] if ends.size else 0) + np.repeat(starts[symbols] - (ends - lengths), lengths)]


def pack(documents: list[np.ndarray], end_id: int = END_ID) -> bytes:
    """A block: head, rules with the lengths of their expansions, per document its number of ids
    and its first symbol, then the symbols. Ids must be below ``TERMINALS``."""
    marked = [np.append(d, MARK).astype(np.uint16) for d in documents]
    symbols, rules = compress(np.concatenate([np.zeros(0, np.uint16), *marked]))
    ids = [1] * (MARK + 1)  # by symbol
    for x, y in rules.T.tolist():
        ids.append(ids[x] + ids[y])
    lengths = np.array(ids[MARK + 1 :])
    sizes = np.array([d.size for d in marked], np.int64)
    firsts = np.concatenate([[0], np.flatnonzero(symbols == MARK) + 1]).astype(np.int64)
    head = struct.pack("<4sIIIQ", MAGIC, end_id, len(documents), rules.shape[1], symbols.size)
    parts = (rules.astype("<u2"), lengths.astype("<u4"), sizes.astype("<u8"), firsts.astype("<u8"), symbols.astype("<u2"))
    return head + b"".join(p.tobytes() for p in parts)


class Block:
    """A packed block; ``document(k)`` decodes one document without the others."""

    def __init__(self, data: bytes):
        magic, self.end_id, self.documents, rules, symbols = struct.unpack_from("<4sIIIQ", data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = struct.calcsize("<4sIIIQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            return np.frombuffer(data, kind, n, at - n * np.dtype(kind).itemsize)

        self.rules = take("<u2", 2 * rules).reshape(2, -1).astype(np.int32)
        self.lengths = take("<u4", rules)
        self.sizes = take("<u8", self.documents).astype(np.int64)
        self.firsts = take("<u8", self.documents + 1).astype(np.int64)
        self.symbols = take("<u2", symbols)

    def _ids(self, symbols: np.ndarray) -> np.ndarray:
        ids = _expand(symbols, self.rules)
        return np.where(ids == MARK, self.end_id, ids).astype("<u4")

    def document(self, k: int) -> np.ndarray:
        return self._ids(self.symbols[self.firsts[k] : self.firsts[k + 1]])

    def all(self) -> list[np.ndarray]:
        ids = self._ids(self.symbols)
        ends = np.cumsum(self.sizes)
        return [ids[b - n : b] for b, n in zip(ends, self.sizes)]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_column: str = "doc_id") -> None:
    """Encodes every whole text with the tokenizer file and writes a table of blocks to ``path``.

    Documents are ordered by id (null first, then by a hash of the text) over range partitions,
    each of which becomes blocks of about ``BLOCK_IDS`` ids with a grammar each. Columns of the
    table: ``shard, block`` (order), ``before`` (ids of earlier blocks of the shard), ``n_ids``,
    ``doc_ids`` and ``payload``. A null text is empty: its ids are the end id alone. Ids may
    repeat; repeated rows are written as often as they stand in ``docs``; other columns are not
    read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    largest = max(Tokenizer.from_file(tokenizer).get_vocab().values())
    if max(largest, end_id) >= TERMINALS:
        raise ValueError(f"ids up to {largest}; the format holds ids below {TERMINALS}")
    # Every shard encodes each of its distinct chunks once, so shards are twice the usual size.
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    text = F.coalesce("text", F.lit(""))
    placed = (
        docs.select(F.col(id_column).cast("bigint").alias("_id"), text.alias("text"), F.xxhash64(text).alias("_order"))
        .repartitionByRange(shards, "_id", "_order")
        .sortWithinPartitions("_id", "_order")
        .select("_id", "text")
    )

    def blocks(batches):
        encoder = Encoder(model.value)
        shard, block, before, held, names, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                    pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([pack(held, end_id)], pa.binary()),
                ],
                ["shard", "block", "before", "n_ids", "doc_ids", "payload"],
            )

        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                for name, ids in zip(part.column("_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                    held.append(ids)
                    names.append(name)
                    size += ids.size + 1
                    if size >= BLOCK_IDS:
                        yield row()
                        block, before, held, names, size = block + 1, before + size, [], [], 0
        if held:
            yield row()
        del encoder
        give_back()

    schema = "shard int, block int, before bigint, n_ids bigint, doc_ids array<bigint>, payload binary"
    placed.mapInArrow(blocks, schema).write.parquet(path)


def read_ids(spark: SparkSession, path: str, id_column: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """From the files of ``write_ids``: the id, ``start`` (ids of all documents before),
    ``n_tokens, ids_crc32`` and, if wanted, ``ids``, for every document.

    Ids are null where they were written as null, and repeat as they were written. Files without
    documents give no rows. Offsets add up one row per shard, not per document.
    """
    table = spark.read.parquet(path)
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = table.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    located = table.join(offsets, F.col("shard") == F.col("_shard")).select(
        (F.col("offset") + F.col("before")).alias("offset"), "doc_ids", "payload"
    )

    def decode(batches):
        for batch in batches:
            for offset, names, payload in zip(batch.column("offset").to_pylist(), batch.column("doc_ids"), batch.column("payload")):
                documents = Block(payload.as_py()).all()
                sizes = np.array([d.size for d in documents], np.int64)
                ends = np.cumsum(sizes)
                columns = {
                    "_id": names.values, "start": pa.array(offset + ends - sizes), "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([zlib.crc32(d.tobytes()) for d in documents], pa.int64()),
                }
                if with_ids:
                    flat = pa.array(np.concatenate(documents).astype(np.int32))
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return located.mapInArrow(decode, schema).withColumnRenamed("_id", id_column)


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_column: str = "doc_id") -> DataFrame:
    """Writes the ids of ``docs`` to a new place in the shared folder and returns what the files
    say: the id, ``start, n_tokens, ids_crc32`` of every document. Null texts, null and repeated ids and
    empty tables are as in ``write_ids``: one row for every row of ``docs``, other columns unread."""
    spark = docs.sparkSession
    path = work_path(spark, "ids")
    write_ids(docs, path, tokenizer, end_id, id_column)
    return read_ids(spark, path, id_column, with_ids=False)
