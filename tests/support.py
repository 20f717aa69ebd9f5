"""Helpers shared by the tests."""

from __future__ import annotations

import datetime as dt
import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def rows(df, *cols):
    """Rows of a result as sorted tuples."""
    df = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in df.collect()), key=repr)


def purchases(spark, data):
    """(customer, order, day, amount) as conformed purchases."""
    made = [
        (c, o, dt.datetime.fromisoformat(day) if day else None, None if a is None else round(a * 100))
        for c, o, day, a in data
    ]
    return spark.createDataFrame(
        made, "customer_id bigint, order_id bigint, order_ts timestamp_ntz, cents bigint"
    )


def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()
