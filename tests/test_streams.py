"""Streams against the batch result of the same events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from support import SMALL, plan_text, rows

from lapsewise import sources, streaming
from lapsewise.plans import catalogue
from lapsewise.session import work_path
from lapsewise.streaming import kept

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def folder(spark):
    return work_path(spark, "events-in")


def put(spark, folder, events):
    """One file of (event_id, hours after start, user, type, value)."""
    data = [(i, START + dt.timedelta(hours=h), u, t, v, "{}") for i, h, u, t, v in events]
    spark.createDataFrame(data, sources.SCHEMAS["events"]).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out):
    stream = streaming.event_stream(spark, folder, files_per_batch=1)
    query = streaming.write_activity(
        streaming.activity_stream(stream, "1 day"), f"{out}/data", f"{out}/state"
    )
    query.awaitTermination()
    return query


def test_days_close_late_rows_drop_and_repeats_count_once(spark, folder):
    out = work_path(spark, "activity")
    put(spark, folder, [(1, 1, 7, "purchase", 2.5), (2, 2, 7, "view", 1.0), (3, 30, 8, "view", 1.0)])
    run(spark, folder, out)
    put(spark, folder, [(2, 2, 7, "view", 1.0), (4, 100, 7, "click", 1.0)])
    run(spark, folder, out)
    # Event 5 is four days behind the newest.
    put(spark, folder, [(5, 5, 7, "view", 9.0), (6, 101, 9, "view", 1.0)])
    query = run(spark, folder, out)
    dropped = sum(
        op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]
    )
    assert dropped > 0
    got = spark.read.parquet(f"{out}/data")
    assert rows(got, F.date_format("day_start", "yyyy-MM-dd"), "customer_id", "events", "purchases", F.col("value").cast("double")) == [
        ("2024-01-01", 7, 2, 1, 3.5), ("2024-01-02", 8, 1, 0, 1.0),
    ]


def test_a_table_is_a_file_or_a_folder(spark, folder):
    events = sources.load(spark, SMALL, "events")
    events.repartition(3).write.parquet(f"{folder}/events.parquet")
    for path in (f"{folder}/events.parquet", f"{SMALL}/events.parquet"):
        out = work_path(spark, "counted")
        stream = streaming.event_stream(spark, path, files_per_batch=1)
        stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(f"{out}/data").count() == events.count() > 0


def test_a_value_beyond_its_type_is_counted(spark, folder):
    out = work_path(spark, "activity")
    put(spark, folder, [(1, 1, 7, "purchase", 2.5), (2, 2, 7, "view", 1e30), (3, 3, 7, "view", None)])
    run(spark, folder, out)
    put(spark, folder, [(4, 200, 7, "click", 1.0)])
    run(spark, folder, out)
    got = spark.read.parquet(f"{out}/data")
    assert rows(got, "customer_id", "events", F.col("value").cast("double"), "bad_values") == [(7, 3, 2.5, 1)]


def test_closed_and_open_days_hold_every_event(spark, folder):
    out = work_path(spark, "activity")
    put(spark, folder, [(1, 1, 7, "purchase", 2.5), (2, 30, 8, "view", 1.0)])
    put(spark, folder, [(3, 50, 8, "view", 1.0), (3, 50, 8, "view", 1.0), (4, 99, 7, "view", 1.0)])
    run(spark, folder, out)
    stored = spark.read.schema(sources.SCHEMAS["events"]).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    whole = spark.read.parquet(f"{out}/data").unionByName(streaming.open_activity(stored, "1 day"))
    assert rows(whole, F.date_format("day_start", "yyyy-MM-dd"), "customer_id", "events") == [
        ("2024-01-01", 7, 1), ("2024-01-02", 8, 1), ("2024-01-03", 8, 1), ("2024-01-05", 7, 1),
    ]


def test_whole_activity_counts_files_out_of_time_order(spark, folder, monkeypatch):
    for n, hour in enumerate((400, 10, 200, 34, 500, 11)):
        put(spark, f"{folder}/events.parquet", [(2 * n, hour, 7, "view", 1.0), (2 * n + 1, hour, 8, "purchase", 2.0)])
    # As in a table of more files than a batch takes.
    stream = streaming.event_stream
    monkeypatch.setattr(streaming, "event_stream", lambda spark, path: stream(spark, path, files_per_batch=1))
    got = rows(catalogue.p4_activity_stream(spark, folder), "day", "customer_id", "events", "purchases", "value")
    days = {"2024-01-01": 2, "2024-01-02": 1, "2024-01-09": 1, "2024-01-17": 1, "2024-01-21": 1}
    assert got == sorted((d, u, n, n * (u == 8), n * (u - 6.0)) for d, n in days.items() for u in (7, 8))


def test_ordered_files_equal_batch_on_closed_days(spark, folder):
    events = sources.load(spark, SMALL, "events")
    for part in range(4):
        events.where(F.floor((F.dayofmonth("ts") - 1) / 8) == part).coalesce(1).write.mode("append").parquet(folder)
    out = work_path(spark, "activity")
    run(spark, folder, out)
    last = events.agg(F.max("ts")).first()[0] - dt.timedelta(days=1)
    day = F.date_trunc("day", "ts")
    want = (
        events.withColumn("day", day)
        .where(F.col("day") + F.expr("interval 1 day") <= F.lit(last))
        .groupBy("day", "user_id").agg(F.count("*").alias("events"))
    )
    got = spark.read.parquet(f"{out}/data")
    as_text = F.date_format(got["day_start"], "yyyy-MM-dd")
    assert rows(got, as_text, "customer_id", "events") == rows(
        want, F.date_format("day", "yyyy-MM-dd"), "user_id", "events"
    )


def test_scoring_repeats_no_event(spark, folder):
    scores = spark.createDataFrame([(7, 80.0, "critical")], "customer_id bigint, risk double, band string")
    put(spark, folder, [(1, 1, 7, "view", 1.0), (2, 2, 8, "view", 1.0)])
    put(spark, folder, [(3, 3, 7, "view", 1.0)])
    out = work_path(spark, "scored")
    for state in ("state", "state", "restarted"):
        # With a lost checkpoint the same batches are written over, not added.
        stream = streaming.event_stream(spark, folder, files_per_batch=1)
        streaming.score_stream(stream, scores, f"{out}/data", f"{out}/{state}").awaitTermination()
    got = spark.read.parquet(f"{out}/data")
    assert rows(got, "event_id", "customer_id", "risk", "band", "known") == [
        (1, 7, 80.0, "critical", 1), (2, 8, None, None, 0), (3, 7, 80.0, "critical", 1),
    ]


# Days that are kept up to date


SENT = [
    # id, hours, user, type, value
    [(1, 1, 7, "purchase", 2.5), (2, 2, 7, "view", 1.0), (3, 30, 8, "view", None)],
    [(2, 2, 7, "view", 1.0), (4, 100, 7, "click", 1e30), (None, 3, 7, "view", 0.25), (None, 3, 7, "view", 0.25)],
    [(5, 5, 7, "purchase", 9.0), (3, 30, 6, "view", None), (6, None, 9, "view", 1.0), (7, 31, None, None, 1.5)],
    [(3, 30, 8, "view", None), (6, None, 9, "view", 1.0), (1, 1, 7, "purchase", 2.5), (1, 1, 7, "purchase", 2.5)],
]
KEPT = [
    (None, 9, 1, 0, 1.0, 0), ("2024-01-01", 7, 5, 2, 13.0, 0), ("2024-01-02", None, 1, 0, 1.5, 0),
    ("2024-01-02", 6, 1, 0, None, 0), ("2024-01-05", 7, 1, 0, None, 1),
]


def send(spark, folder, events):
    data = [(i, h if h is None else START + dt.timedelta(hours=h), u, t, v, "{}") for i, h, u, t, v in events]
    spark.createDataFrame(data, sources.SCHEMAS["events"]).coalesce(1).write.mode("append").parquet(folder)


def kept_rows(spark, path, days=None):
    day = F.date_format("day", "yyyy-MM-dd")
    found = kept.activity(spark, path, days)
    return rows(found, day, "customer_id", "events", "purchases", F.col("value").cast("double"), "bad_values")


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_kept_days_do_not_depend_on_the_order_of_files(spark, folder, order):
    """Late rows, repeats, repeats that differ (event 3), rows without id, time, user or value."""
    out = work_path(spark, "kept")
    for k in order:
        send(spark, folder, SENT[k])
        stream = streaming.event_stream(spark, folder, files_per_batch=1)
        kept.keep_activity(stream, f"{out}/days", f"{out}/state").awaitTermination()
    assert kept_rows(spark, f"{out}/days") == sorted(KEPT, key=repr)
    assert kept_rows(spark, f"{out}/days", [dt.date(2024, 1, 5), None]) == sorted([KEPT[0], KEPT[4]], key=repr)


def test_a_batch_reads_its_own_days_only_and_can_be_repeated(spark):
    out = work_path(spark, "kept")
    events = spark.createDataFrame(
        [(n, START + dt.timedelta(days=n % 40), n % 3, "view", 1.0, "{}") for n in range(400)], sources.SCHEMAS["events"]
    )
    stream = lambda k: events.where(f"event_id % 4 = {k}")
    for name, schema in (("versions", kept.VERSIONS), ("partials", kept.PARTIALS)):
        spark.createDataFrame([], schema).write.partitionBy("day", "batch").parquet(f"{out}/{name}")
    for k in range(4):
        kept.merge_batch(stream(k), k, out)
    before = kept_rows(spark, out)
    kept.merge_batch(stream(3), 3, out)
    assert kept_rows(spark, out) == before and sum(r[2] for r in before) == 400
    one = kept.known(spark, out, [START.date()], 9)
    assert one.count() == 10
    filters = [x for x in plan_text(one).splitlines() if "PartitionFilters" in x]
    assert filters and "day" in filters[0].split("PartitionFilters")[1]  # other days' files are not opened
