"""Column expressions shared by the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

# Fits 64 bits, which keeps sorting and comparing cheap.
MONEY = "decimal(18,2)"


def as_date(day: str | dt.date) -> dt.date:
    return day if isinstance(day, dt.date) else dt.date.fromisoformat(day)


def at(day: str | dt.date, plus_days: int = 0) -> Column:
    """Midnight of a day as a zone-less literal, so that filters reach the parquet scan."""
    moment = as_date(day) + dt.timedelta(days=plus_days)
    return F.lit(dt.datetime.combine(moment, dt.time())).cast(TimestampNTZType())


def money(cents: Column | str) -> Column:
    """A sum of cents as a decimal amount. Sums run on integer cents, which stay exact and
    are several times cheaper to add than wide decimals."""
    cents = F.col(cents) if isinstance(cents, str) else cents
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def ratio(top: Column, bottom: Column) -> Column:
    """Double quotient; NULL when the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def iso(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def percent_bucket(key: Column | str, salt: str) -> Column:
    """0..99 from the key alone: stable across runs, engines and partitionings."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(salt), F.lit(":"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100


def ntile_of(row_number: Column, rows: Column, k: int) -> Column:
    """The SQL ``ntile(k)`` bucket of a row, from its row number and the row count."""
    small = F.floor(rows / F.lit(k))
    extra = rows % k
    head = extra * (small + 1)
    in_head = F.ceil(row_number / (small + 1))
    in_tail = extra + F.ceil((row_number - head) / F.greatest(small, F.lit(1)))
    return F.when(row_number <= head, in_head).otherwise(in_tail).cast("int")


def entropy(shares: Sequence[Column]) -> Column:
    terms = [F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0)) for p in shares]
    return sum(terms[1:], terms[0])
