"""Checks on keys, references and rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate(df: DataFrame, table: str, key: str, rules: Mapping[str, str]) -> DataFrame:
    """One row ``(table, rule, key)`` per broken rule, all rules in one pass.

    A rule is a predicate that must hold; NULL does not count as holding.
    """
    broken = [
        F.when(~F.coalesce(F.expr(predicate), F.lit(False)), F.lit(rule))
        for rule, predicate in rules.items()
    ]
    return df.select(
        F.lit(table).alias("table"),
        F.explode(F.array_compact(F.array(*broken))).alias("rule"),
        F.col(key).cast("string").alias("key"),
    )


@dataclass(frozen=True)
class PathRule:
    """What stands at ``path`` of a JSON document must have ``type`` and hold ``predicate`` (on
    ``value``); where nothing stands there, only a ``required`` path is a violation."""

    path: str
    type: str
    predicate: str = "true"
    required: bool = True


def validate_json(df: DataFrame, table: str, key: str, column: str, rules: Mapping[str, PathRule]) -> DataFrame:
    """One row ``(table, rule, key)`` per broken rule about the documents in ``column``.

    A text that is no JSON breaks ``not_json`` alone; NULL has no document, so its required paths
    are missing. Texts are parsed once; a JSON null counts as nothing. NULL does not count as
    holding.
    """
    parsed = df.select(F.col(key).cast("string").alias("_key"), F.col(column).alias("_text"), F.try_parse_json(column).alias("_doc"))
    broken = [F.when(F.col("_text").isNotNull() & F.col("_doc").isNull(), F.lit("not_json"))]
    readable = F.col("_text").isNull() | F.col("_doc").isNotNull()
    values = {}
    for k, (rule, what) in enumerate(rules.items()):
        # What is there but does not fit the type is a NULL value.
        values[f"_there_{k}"] = F.try_variant_get("_doc", what.path, "variant")
        values[f"_value_{k}"] = F.try_variant_get("_doc", what.path, what.type)
        there = F.col(f"_there_{k}").isNotNull() & ~F.is_variant_null(F.col(f"_there_{k}"))
        fails = ~F.coalesce(F.expr(f"exists(array(_value_{k}), value -> value is not null and ({what.predicate}))"), F.lit(False))
        broken.append(F.when(readable & F.when(there, fails).otherwise(F.lit(what.required)), F.lit(rule)))
    return parsed.withColumns(values).select(
        F.lit(table).alias("table"), F.explode(F.array_compact(F.array(*broken))).alias("rule"), F.col("_key").alias("key")
    )


def violation_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("violations"))


def fk_check(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Key values of the child that the parent lacks, with the rows that use them.

    Counted before the join, so a frequent key is one row when it meets the parent. NULL keys
    refer to nothing and are no violation.
    """
    used = (
        child.where(F.col(fk).isNotNull())
        .groupBy(F.col(fk).alias("missing_key"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    known = parent.select(F.col(pk).alias("missing_key"))
    return used.join(known, "missing_key", "left_anti")


def handle_missing(orders: DataFrame, customers: DataFrame, mode: str) -> DataFrame:
    """Treat orders whose customer record is missing.

    ``drop`` keeps the orders with a record, ``quarantine`` the others (NULL customer included);
    ``placeholder`` returns the customers plus an empty record per missing id.
    """
    keys = customers.select("customer_id")
    if mode == "drop":
        return orders.join(keys, "customer_id", "left_semi")
    if mode == "quarantine":
        return orders.join(keys, "customer_id", "left_anti")
    if mode == "placeholder":
        missing = fk_check(orders, "customer_id", customers, "customer_id")
        empty = missing.select(F.col("missing_key").alias("customer_id"), F.lit(True).alias("placeholder"))
        return customers.withColumn("placeholder", F.lit(False)).unionByName(
            empty, allowMissingColumns=True
        )
    raise ValueError(f"unknown mode {mode!r}")


def key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values used by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
