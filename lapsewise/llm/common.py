"""Small expressions several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; Spark's ``lower`` does the same on ASCII and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(-1))
