"""Behaviour events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lapsewise.operators.serving import lookup
from lapsewise.session import freeze
from lapsewise.sources import SCHEMAS


#: Files of a batch, so that a long history does not become one batch.
FILES_PER_BATCH = 1_000


def event_stream(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The event table at ``path``, a file or a folder of part files, as a stream, oldest first.
    Event time gets the session zone (UTC), which watermarks need."""
    reader = spark.readStream.schema(StructType.fromDDL(SCHEMAS["events"]))
    reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern, since a stream takes a plain path for a folder only.
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def activity_stream(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Events and value per customer and day, repeats removed, rows later than ``delay`` dropped.

    A value beyond its type is left out of the sum and counted in ``bad_values``; it does not end
    the stream.
    """
    return _per_day(events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]))


def _per_day(events: DataFrame) -> DataFrame:
    value = F.col("value").try_cast("decimal(18,2)")
    return (
        events.groupBy(F.window("ts", "1 day"), "user_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("event_type") == "purchase").alias("purchases"),
            F.sum(value).alias("value"),
            F.count_if(F.col("value").isNotNull() & value.isNull()).alias("bad_values"),
        )
        .select(
            F.col("window.start").alias("day_start"),
            F.col("user_id").alias("customer_id"),
            "events",
            "purchases",
            "value",
            "bad_values",
        )
    )


def open_activity(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """The days that ``activity_stream`` has not closed yet, from the stored events as a batch.

    With the closed days they are every event's day. Only the days since the watermark are read.
    """
    last = events.select(F.max("ts").alias("last")).scalar()
    since = F.date_trunc("day", last - F.expr(f"interval {delay}"))
    return _per_day(events.where(F.col("ts") >= since).dropDuplicates(["event_id"]))


def whole_activity(closed: DataFrame, events: DataFrame) -> DataFrame:
    """Every day with all its stored events, repeats removed: days that ``activity_stream`` has
    closed with all of them as they are; the open ones, and those whose late rows it dropped,
    counted again from the stored events as a batch."""
    once = events.dropDuplicates(["event_id"]).withColumn("_day", F.date_trunc("day", "ts"))
    had = closed.groupBy("day_start").agg(F.sum("events").alias("had"))
    stored = once.groupBy("_day").agg(F.count(F.lit(1)).alias("has"))
    again, _ = freeze(
        stored.join(had, F.col("_day") == F.col("day_start"), "left").where("had is null or had <> has").select("_day")
    )
    kept = closed.join(again, F.col("day_start") == F.col("_day"), "left_anti")
    return kept.unionByName(_per_day(once.join(again, "_day", "left_semi")))


def write_activity(activity: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed days to a parquet table and stop when the input is used up."""
    return (
        activity.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def score_events(events: DataFrame, scores: DataFrame) -> DataFrame:
    """Each event with the score of its customer, ``known`` = 0 without one.

    A lookup, so that a small batch does not shuffle the whole score table.
    """
    asked = events.select("event_id", "ts", F.col("user_id").alias("customer_id"), "event_type")
    answered = lookup(scores.select("customer_id", "risk", "band"), asked)
    return answered.select(
        "event_id", "ts", "customer_id", "event_type", "risk", "band", F.col("found").alias("known")
    )


def score_stream(events: DataFrame, scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Score events batch by batch into ``path/batch=<id>``.

    A repeated batch overwrites its own folder. The join runs as a batch plan, so that a
    customer with very many events is split like any skewed join side.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # The batch is used twice; it is written, since cached blocks go with their executor.
        rows, _ = freeze(batch)
        score_events(rows, scores).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
