"""Placement by a permutation-filled lookup table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the table: a prime, so that every step size visits all slots.
SLOTS = 65_537


def _number(text: str, salt: str) -> int:
    return int.from_bytes(sha256(f"{salt}:{text}".encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str] | Mapping[str, int], slots: int = SLOTS) -> np.ndarray:
    """``table[slot]``: position of a shard in sorted name order.

    Every shard has its own preference order over all slots, ``offset + k * step``. The shards
    take turns; a shard with weight w takes w slots a turn. In a turn a shard claims the next slot
    of its order that is still free, until none is. Shares of equally weighted shards differ by at
    most one slot, and dropping a shard moves few slots besides its own.
    """
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(shards, 1)
    names = sorted(weights)
    if not names or min(weights.values()) < 1 or sum(weights.values()) > slots:
        raise ValueError("one shard at least, whole weights from 1, and no more turns than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not a prime")
    at = [_number(n, "offset") % slots for n in names]
    step = [_number(n, "step") % (slots - 1) + 1 for n in names]
    table, free = np.full(slots, -1, np.int32), slots
    while free:
        for shard, name in enumerate(names):
            for _ in range(weights[name]):
                if not free:
                    break
                while table[at[shard]] >= 0:
                    at[shard] = (at[shard] + step[shard]) % slots
                table[at[shard]] = shard
                free -= 1
    return table


def place(
    df: DataFrame, key: str, shards: Sequence[str] | Mapping[str, int], slots: int = SLOTS
) -> DataFrame:
    """``df`` with its columns and ``slot`` (int) and ``shard`` (string); columns of these names
    are replaced.

    Rows with equal keys share a slot, so repeated rows stay together and reruns agree; a null key
    is placed like the empty text. The table has ``slots`` rows whatever the data, so it is
    broadcast: a row is placed where it lies, without a shuffle.
    """
    names = sorted(shards)
    rows = [(slot, names[shard]) for slot, shard in enumerate(lookup_table(shards, slots).tolist())]
    table = df.sparkSession.createDataFrame(rows, "_slot int, _shard string")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = df.select(F.struct("*").alias("_row"), F.pmod(F.xxhash64(text), slots).cast("int").alias("_slot"))
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    return placed.join(F.broadcast(table), "_slot").select(
        *[F.col("_row")[c].alias(c) for c in kept], F.col("_slot").alias("slot"), F.col("_shard").alias("shard")
    )
