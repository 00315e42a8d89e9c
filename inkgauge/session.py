"""Session helpers: tuned session, shared work folder, bounded lookup tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# A lookup table is captured by a function of the tasks only below both bounds.
LOOKUP_MAX_ROWS = 200_000
LOOKUP_MAX_BYTES = 16 * 1024 * 1024
# The least input a partition of a spread table holds, and the most while there are fewer than SPREAD_TASKS a core.
SPREAD_BYTES, SPREAD_MOST = 256 * 1024, 1024 * 1024
SPREAD_TASKS = 256
# Spark's estimate of an input it knows nothing about is beyond this.
UNKNOWN_BYTES = 1 << 50


def local_session(cpus: int | str = 8, app: str = "inkgauge", memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="inkgauge-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_table(df: DataFrame) -> DataFrame:
    """A lookup side, evaluated once into the shared folder.

    The size of the written table is known, so Spark ships it to all tasks if it
    is below its own limit and shuffles it otherwise; no row passes the driver.
    """
    return written(df, "lookup")


def small_rows(table: DataFrame, max_rows: int = LOOKUP_MAX_ROWS, max_bytes: int = LOOKUP_MAX_BYTES) -> list[Row] | None:
    """All rows of a written table, or None beyond either bound.

    Both are measured before a row moves, so what the driver holds and tasks get
    is bounded in rows and in bytes.
    """
    rows, size = table.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))).first()
    if rows > max_rows or (size or 0) > max_bytes:
        return None
    return table.collect()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows out by ``key`` in small partitions.

    Meant before work that is heavy per row: however the files are split, a task gets
    about ``SPREAD_MOST`` of the estimated input, and a small input goes to twice the
    cores.  What is grouped by ``key`` (and more) afterwards is together already, so of
    all that is made from a text only the text itself is shuffled.  An input of unknown
    size is left alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:
        return df
    least = min(2 * cores, size // SPREAD_BYTES + 1)
    return df.repartition(max(least, min(SPREAD_TASKS * cores, size // SPREAD_MOST + 1)), key)
