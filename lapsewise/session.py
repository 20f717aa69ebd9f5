"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator counts on. Skewed join sides are split by adaptive
# execution even where that costs an extra shuffle: a customer, part or nation may hold
# a third of all rows.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # A total beyond its type is an error, never a wrong number.
    "spark.sql.ansi.enabled": "true",
    # Rows go to Python in batches; whole texts are large rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Stream state may outgrow the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "lapsewise") -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        # Call-site capture for error messages costs more than building most plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="lapsewise-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lapsewise/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> tuple[DataFrame, int]:
    """Write ``df`` once as a table in the shared folder; return the table and its row count.

    Lineage ends at the files, so later steps survive the loss of executors without repeating
    earlier ones. The count comes from the file footers.
    """
    path = work_path(df.sparkSession, "frozen")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table, table.count()
