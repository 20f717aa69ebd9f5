"""Daily activity that is kept up to date: a batch of events changes the days it holds, no others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lapsewise.functions import money
from lapsewise.session import freeze
from lapsewise.sources import save

#: What an event says, smallest first where an id says several things on one day.
SAID = ("customer_id", "purchase", "cents", "bad")
VERSIONS = "event_id bigint, customer_id bigint, purchase int, cents bigint, bad int, day date, batch bigint"
PARTIALS = "customer_id bigint, events bigint, purchases bigint, cents bigint, valued bigint, bad_values bigint, day date, batch bigint"


def _told(events: DataFrame) -> DataFrame:
    value = F.col("value").try_cast("decimal(18,2)")
    return events.select(
        F.to_date("ts").alias("day"), "event_id", F.col("user_id").alias("customer_id"),
        F.coalesce(F.col("event_type") == "purchase", F.lit(False)).cast("int").alias("purchase"),
        (value * 100).cast("bigint").alias("cents"), (F.col("value").isNotNull() & value.isNull()).cast("int").alias("bad"),
    )


def _tallied(rows: DataFrame) -> DataFrame:
    """Partial sums per day and customer of signed events; rows of one event cancel out exactly."""
    sign, cents = F.col("sign"), F.col("cents")
    return rows.groupBy("day", "customer_id").agg(
        F.sum(sign).alias("events"), F.sum(sign * F.col("purchase")).alias("purchases"),
        F.coalesce(F.sum(sign * cents), F.lit(0)).alias("cents"),
        F.coalesce(F.sum(F.when(cents.isNotNull(), sign)), F.lit(0)).alias("valued"), F.sum(sign * F.col("bad")).alias("bad_values"),
    )


def _in_days(days: Sequence) -> Column:
    """Rows of ``days``, as a filter on the partition column, so that other days are not opened."""
    some = F.col("day").isin([d for d in days if d is not None])
    return (some | F.col("day").isNull()) if None in days else some


def known(spark: SparkSession, path: str, days: Sequence, batch_id: int) -> DataFrame:
    """``day, event_id, was``: what earlier batches have told of the events of ``days``."""
    stored = spark.read.schema(VERSIONS).parquet(f"{path}/versions").where(_in_days(days) & (F.col("batch") < batch_id))
    return stored.groupBy("day", "event_id").agg(F.min(F.struct(*SAID)).alias("was"))


def merge_batch(events: DataFrame, batch_id: int, path: str) -> None:
    """Add one batch to the kept days at ``path``.

    An event is a day and an id; a repeat in this or an earlier batch counts once, and of repeats
    that differ the smallest row counts, whatever order they come in: what an earlier batch had
    counted is then taken back by a negative partial sum. Rows without an id all count. Days come
    from the event time, those without one have a NULL day. Only stored events of the batch's own
    days are read. A repeated batch overwrites its own partitions.
    """
    spark = events.sparkSession
    told, _ = freeze(_told(events))
    days = [r.day for r in told.select("day").distinct().collect()]  # the calendar bounds them
    fresh = told.where("event_id is not null").groupBy("day", "event_id").agg(F.min(F.struct(*SAID)).alias("now"))
    earlier = known(spark, path, days, batch_id).select(F.col("day").alias("_day"), F.col("event_id").alias("_id"), "was")
    met = fresh.join(earlier, F.col("day").eqNullSafe(F.col("_day")) & (F.col("event_id") == F.col("_id")), "left")
    changed, _ = freeze(met.where("was is null or now < was").select("day", "event_id", "now", "was"))
    save(changed.select("event_id", "now.*", "day", F.lit(batch_id).cast("bigint").alias("batch")), f"{path}/versions", ("day", "batch"))
    signed = changed.select("day", F.lit(1).alias("sign"), "now.*").union(
        changed.where("was is not null").select("day", F.lit(-1).alias("sign"), "was.*")
    ).union(told.where("event_id is null").select("day", F.lit(1).alias("sign"), *SAID))
    save(_tallied(signed).withColumn("batch", F.lit(batch_id).cast("bigint")), f"{path}/partials", ("day", "batch"))


def keep_activity(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of events batch by batch into the kept days at ``path``; stop when the input
    is used up. No watermark: however late an event comes, its day gets it."""
    spark = events.sparkSession
    for name, schema in (("versions", VERSIONS), ("partials", PARTIALS)):
        # Nothing is written to tables that are there already.
        spark.createDataFrame([], schema).write.mode("append").partitionBy("day", "batch").parquet(f"{path}/{name}")

    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def activity(spark: SparkSession, path: str, days: Sequence | None = None) -> DataFrame:
    """``day, customer_id, events, purchases, value, bad_values`` of the kept days, or of some."""
    stored = spark.read.schema(PARTIALS).parquet(f"{path}/partials")
    if days is not None:
        stored = stored.where(_in_days(days))
    summed = stored.groupBy("day", "customer_id").agg(*[F.sum(c).alias(c) for c in ("events", "purchases", "cents", "valued", "bad_values")])
    return summed.where("events > 0").select(
        "day", "customer_id", "events", "purchases", F.when(F.col("valued") > 0, money("cents")).alias("value"), "bad_values"
    )
