"""Predictions kept as a bucketed table: one row per customer, merged snapshot by snapshot."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.operators.serving import lookup

KEY = "customer_id"
#: Ids that are asked for by value; a longer list is a join.
MOST_IDS = 1_000


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions, oldest first: Spark marks a folder when all of it has been written."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
    done = [n for n in names if re.fullmatch(r"v\d{8}", n) and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(done)


def _register(spark: SparkSession, location: str, columns: str, buckets: int) -> DataFrame:
    """The folder as a bucketed table of this session's catalog, so that plans know its buckets."""
    name = f"predictions_{uuid.uuid5(uuid.NAMESPACE_URL, location).hex}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    return spark.table(name)


def _described(spark: SparkSession, location: str) -> tuple[str, int]:
    """Columns and buckets of a version, as written beside it."""
    row = spark.read.json(f"{location}.about").first()
    return row["columns"], row["buckets"]


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of the store at ``path``."""
    versions = _versions(spark, path.rstrip("/"))
    if not versions:
        raise ValueError(f"no prediction store at {path}")
    location = f"{path.rstrip('/')}/{versions[-1]}"
    return _register(spark, location, *_described(spark, location))


def merge_snapshot(spark: SparkSession, path: str, snapshot: DataFrame, buckets: int = 64) -> DataFrame:
    """Put a snapshot's predictions (``customer_id, snapshot`` and more) into the store and return it.

    The later snapshot of a customer stays, of equal ones the new row; of several new rows of a
    customer the latest, then the largest by the other columns. Only the store's one row per
    customer is read, never older history, and it is not shuffled: the new rows are dealt to its
    buckets. The result is a new version beside the old one, which readers go on using until the
    new one is complete, and which may be deleted then. The number of buckets is that of the first
    snapshot.
    """
    path = path.rstrip("/")
    rest = [c for c in snapshot.columns if c not in (KEY, "snapshot")]
    latest = snapshot.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.max(F.struct("snapshot", *rest)).alias("new"))
    versions = _versions(spark, path)
    if versions:
        last = f"{path}/{versions[-1]}"
        columns, buckets = _described(spark, last)
        old = _register(spark, last, columns, buckets).select(F.col(KEY), F.struct("snapshot", *rest).alias("old"))
        newer = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new.snapshot") >= F.col("old.snapshot")))
        latest = old.join(latest, KEY, "full").select(KEY, F.when(newer, F.col("new")).otherwise(F.col("old")).alias("new"))
    merged = latest.select(KEY, "new.*")
    location = f"{path}/v{len(versions) + 1:08d}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema)
    about = spark.createDataFrame([(columns, buckets)], "columns string, buckets int")
    about.coalesce(1).write.mode("overwrite").json(f"{location}.about")
    # One task a bucket, so one file a bucket.
    (
        merged.repartition(buckets, KEY).write.mode("overwrite").format("parquet").bucketBy(buckets, KEY).sortBy(KEY)
        .option("path", location).option(f"parquet.bloom.filter.enabled#{KEY}", "true")
        .saveAsTable(f"predictions_{uuid.uuid5(uuid.NAMESPACE_URL, location).hex}")
    )
    return open_store(spark, path)


def ask(store: DataFrame, requests: DataFrame, most_ids: int = MOST_IDS) -> DataFrame:
    """``serving.lookup`` in a store. Up to ``most_ids`` different ids become a filter, which opens
    their buckets only and in these the row groups whose Bloom filter has them; more are a join by
    the buckets."""
    ids = [r[0] for r in requests.select(KEY).where(F.col(KEY).isNotNull()).distinct().limit(most_ids + 1).collect()]
    if len(ids) <= most_ids:
        store = store.where(F.col(KEY).isin(ids))
    return lookup(store, requests)
