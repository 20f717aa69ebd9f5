"""Declared tables: reading, conforming and storing them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The stored tables and their column types.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}
CORRUPT = "_corrupt_record"


def load(spark: SparkSession, folder: str, table: str, fmt: str = "parquet") -> DataFrame:
    """Read a declared table; text formats keep unreadable rows in ``_corrupt_record``."""
    schema = StructType.fromDDL(SCHEMAS[table])
    path = f"{folder.rstrip('/')}/{table}.{fmt}"
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    lenient = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    reader = (
        spark.read.schema(lenient)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    if fmt == "json":
        return reader.json(path)
    raise ValueError(f"unknown format {fmt!r}")


@dataclass(frozen=True)
class Target:
    """One column of a conformed table: source expression and target type."""

    source: str
    type: str


def conform(df: DataFrame, mapping: Mapping[str, Target]) -> DataFrame:
    """Rename and cast; a value that does not fit becomes NULL and its column is flagged.

    ``bad_fields`` lists the flagged columns, comma-separated, '' for a clean row.
    """
    cast = {name: F.expr(t.source).try_cast(t.type) for name, t in mapping.items()}
    # A value that has its type already cannot fail, so its column need not be read for the flags.
    given = df.select(*[F.expr(t.source).alias(name) for name, t in mapping.items()]).schema
    failed = [
        F.when(F.expr(t.source).isNotNull() & cast[name].isNull(), F.lit(name))
        for name, t in mapping.items()
        if given[name].dataType.simpleString() != t.type
    ]
    return df.select(
        *[c.alias(name) for name, c in cast.items()],
        F.concat_ws(",", *failed).alias("bad_fields"),
    )


# Amounts and quantities are taken over as integers: exact and cheap to add up.
PURCHASE = {
    "order_id": Target("o_orderkey", "bigint"),
    "customer_id": Target("o_custkey", "bigint"),
    "order_ts": Target("o_orderdate", "timestamp_ntz"),
    "cents": Target("rint(o_totalprice * 100)", "bigint"),
}
CUSTOMER = {
    "customer_id": Target("c_custkey", "bigint"),
    "nation_id": Target("c_nationkey", "int"),
    "market_segment": Target("c_mktsegment", "string"),
    "balance": Target("c_acctbal", "decimal(18,2)"),
}
LINE = {
    "order_id": Target("l_orderkey", "bigint"),
    "part_id": Target("l_partkey", "bigint"),
    "quantity_hundredths": Target("rint(l_quantity * 100)", "bigint"),
    "discount_bp": Target("rint(l_discount * 10000)", "bigint"),
    "return_flag": Target("l_returnflag", "string"),
}
PART = {
    "part_id": Target("p_partkey", "bigint"),
    "part_type": Target("p_type", "string"),
}


# Stored table -> how its rows are taken over.
MAPPINGS = {"orders": PURCHASE, "customer": CUSTOMER, "lineitem": LINE, "part": PART}


#: Without these a row says nothing about anybody.
KEYS = {"orders": ("order_id", "customer_id"), "customer": ("customer_id",), "lineitem": ("order_id",), "part": ("part_id",)}


def taken_over(spark: SparkSession, folder: str, table: str, flags: bool = False) -> DataFrame:
    """Rows as they are taken over: a value that does not fit is NULL, and only a row whose key does
    not fit is left out. ``set_aside`` tells of both; with ``flags`` the rows keep ``bad_fields``."""
    done = conform(load(spark, folder, table), MAPPINGS[table])
    for key in KEYS[table]:
        done = done.where(F.find_in_set(F.lit(key), "bad_fields") == 0)
    return done if flags else done.drop("bad_fields")


def set_aside(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """``table, bad_fields`` and the row as JSON, for every row with a value that does not fit."""
    bad = load(spark, folder, table)
    failed = conform(bad.withColumn("_row", F.to_json(F.struct(*bad.columns))), {**MAPPINGS[table], "row": Target("_row", "string")})
    return failed.where("bad_fields <> ''").select(F.lit(table).alias("table"), "bad_fields", "row")


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """``order_id, customer_id, order_ts, cents``; one row per order."""
    return taken_over(spark, folder, "orders")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return taken_over(spark, folder, "customer")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return taken_over(spark, folder, "lineitem")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return taken_over(spark, folder, "part")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """``nation_id, nation, region``."""
    nation = load(spark, folder, "nation")
    region = load(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("nation_id"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
    )


def save(
    df: DataFrame,
    path: str,
    partition_by: tuple[str, ...] = (),
    fmt: str = "parquet",
    whole: bool = False,
) -> None:
    """Store a table; with ``partition_by`` only the partitions present in ``df`` are replaced,
    unless the ``whole`` table is.

    Rows are gathered per partition value by a rebalance, which splits a value too big for
    one task into several files.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    mode = "static" if whole else "dynamic"
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
