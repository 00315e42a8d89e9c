"""Running metrics over statistics rows, as streams or as the same batch query.

Every query below is an ordinary aggregate, so it runs on a static frame (the
batch twin) and on a stream.  Streams keep their state in RocksDB, which spills
to disk, under a checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..fixed import LATENCY_BOUNDS
from ..operators.config import auto_registered, lookup_metric_config
from ..operators.histograms import bound_label, first_bound_of
from ..session import fresh_path
from ..sources.commits import file_system

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def classify(rows: DataFrame) -> DataFrame:
    """One row per observation: ``url, variable, type, bucket, amount``.

    Input rows carry ``type``, ``buckets`` and ``bounds`` from the configuration.
    Scalars go to their first bound, enum values to themselves or to no bucket
    when undeclared; counters and gauges have no bucket.
    """
    rows = rows.withColumn("amount", F.col("value").try_cast("double"))
    number = F.col("amount")
    bucket = (
        F.when(F.col("variable") == "_latency", bound_label(number, LATENCY_BOUNDS))
        .when(F.col("type") == "scalar", first_bound_of(number, F.col("bounds")).cast("string"))
        .when((F.col("type") == "enum") & F.array_contains("buckets", F.col("value")), F.col("value"))
        .when(F.col("type") == "enum", F.lit("__unknown__"))
    )
    return rows.withColumn("bucket", bucket)


def with_bounds(cfg: DataFrame) -> DataFrame:
    """Numeric bounds, parsed once on the small side."""
    return cfg.withColumn("bounds", F.transform("buckets", lambda b: b.try_cast("double")))


def running_metrics(stats: DataFrame, cfg: DataFrame) -> DataFrame:
    """Totals per ``url, variable, type, bucket``: count and sum of amounts.

    ``stats(url, variable, value)``.  The configuration join is a broadcast, so
    the only shuffle is the aggregate, combined per partition first.
    """
    rows = classify(lookup_metric_config(stats, with_bounds(cfg)))
    return rows.groupBy("url", "variable", "type", "bucket").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("type") == "counter", F.col("amount"))).alias("total")
    )


def gauges(stats: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Last value per url and variable by arrival order."""
    return stats.groupBy("url", "variable").agg(F.max_by("value", F.struct(*order)).alias("value"))


def windowed_rates(
    events: DataFrame, bucket: Column, ts: str = "ts", key: str = "url", width: str = "1 minute", late: str = "10 minutes"
) -> DataFrame:
    """Observations per window, url and bucket; rows later than ``late`` are dropped."""
    # a watermark needs a zoned event time
    rows = events.withColumn("bucket", bucket).withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("w"), key, "bucket").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), key, "bucket", "n"
    )


def window_shares(rates: DataFrame, key: str = "url") -> DataFrame:
    """Percent of each bucket in its window, from finished windows."""
    folded = rates.groupBy("window_start", key).agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("bucket", "n")).alias("b")
    )
    return folded.select("window_start", key, "total", F.inline("b")).withColumn(
        "share", 100.0 * F.col("n") / F.col("total")
    )


# -- running the streams ----------------------------------------------------

def numbered_folders(spark: SparkSession, path: str, kind: str = "batch") -> list[int]:
    """The numbers of the ``kind=N`` folders under ``path``, ascending."""
    folder, fs = file_system(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))


def drop_folder(spark: SparkSession, path: str) -> None:
    folder, fs = file_system(spark, path)
    fs.delete(folder, True)


def latest_batch(spark: SparkSession, path: str) -> str | None:
    """The newest ``batch=N`` folder under ``path``."""
    ids = numbered_folders(spark, path)
    return f"{path}/batch={ids[-1]}" if ids else None


#: Takes what has arrived and ends; any other trigger of Spark runs on.
DRAIN = {"availableNow": True}


def start_batches(
    stream: DataFrame, fold: Callable[[DataFrame, int], None], root: str, trigger: Mapping[str, object] = DRAIN, mode: str = "append"
) -> StreamingQuery:
    """Start ``fold(batch, batch_id)`` on every batch and return the running query.

    The checkpoint under ``root`` resumes a stream that was stopped.  With
    ``{"processingTime": "10 seconds"}`` and the like it runs until it is stopped.
    """
    writer = stream.writeStream.outputMode(mode).foreachBatch(fold).option("checkpointLocation", f"{root}/checkpoint")
    return writer.trigger(**trigger).start()


def start_to_table(
    stream: DataFrame, root: str, mode: str = "complete", trigger: Mapping[str, object] = DRAIN
) -> StreamingQuery:
    """Start a stream into a table under ``root``; ``read_table`` reads it at any time.

    Each batch of a complete stream replaces the table under a new batch folder,
    so a batch that runs again after a failure writes the same folder.
    """
    if mode == "append":
        return (
            stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger).start()
        )

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        drop_before(batch.sparkSession, f"{root}/out", batch_id - 1)

    return start_batches(stream, replace, root, trigger, mode)


def drop_before(spark: SparkSession, path: str, number: int) -> None:
    """Drops the tables of batches before ``number``, so that those of the last two stay."""
    for old in numbered_folders(spark, path):
        if old < number:
            drop_folder(spark, f"{path}/batch={old}")


#: Batches of changes after which the whole table is written once.
WHOLE_EVERY = 20


def start_updates(
    stream: DataFrame, root: str, keys: Sequence[str], trigger: Mapping[str, object] = DRAIN, whole_every: int = WHOLE_EVERY
) -> StreamingQuery:
    """Start a running aggregate into a table under ``root`` of which a batch writes only the ``keys`` it changes.

    Spark's keyed state holds the aggregate.  Every ``whole_every`` batches the table is
    written whole and the batches before the whole one before it are dropped, so what
    is kept is bounded by the keys.  A batch that runs again writes the same folders.
    """
    schema = stream.schema

    def change(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{root}/changes"
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % whole_every == 0:
            read_updates(spark, root, schema, keys, batch_id).write.mode("overwrite").parquet(f"{path}/whole={batch_id}")
            before = [n for n in numbered_folders(spark, path, "whole") if n < batch_id]
            for old in before[:-1]:
                drop_folder(spark, f"{path}/whole={old}")
            if before:
                drop_before(spark, path, before[-1] + 1)

    return start_batches(stream, change, root, trigger, "update")


def read_updates(spark: SparkSession, root: str, schema: StructType, keys: Sequence[str], until: int | None = None) -> DataFrame:
    """The table of ``start_updates`` so far, or as of a batch: the newest row of every key."""
    path = f"{root}/changes"
    whole = [n for n in numbered_folders(spark, path, "whole") if until is None or n < until]
    after = whole[-1] if whole else -1
    batches = [n for n in numbered_folders(spark, path) if n > after and (until is None or n <= until)]
    parts = [(f"{path}/whole={after}", after)] if whole else []
    parts += [(f"{path}/batch={n}", n) for n in batches]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = reduce(DataFrame.unionAll, [spark.read.schema(schema).parquet(p).withColumn("_batch", F.lit(n)) for p, n in parts])
    rest = [c for c in schema.names if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in schema.names])


def run_updates(stream: DataFrame, name: str, keys: Sequence[str], root: str | None = None) -> DataFrame:
    """Drain a running aggregate into a table of the shared folder and return the table; a given ``root`` resumes."""
    spark = stream.sparkSession
    root = root or fresh_path(spark, name)
    start_updates(stream, root, keys).awaitTermination()
    return read_updates(spark, root, stream.schema, keys)


def read_table(spark: SparkSession, root: str, schema: StructType | str, mode: str = "complete", folder: str = "out") -> DataFrame:
    """What a stream has written under ``root`` so far."""
    path = f"{root}/{folder}" if mode == "append" else latest_batch(spark, f"{root}/{folder}")
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def run_to_table(stream: DataFrame, name: str, mode: str = "complete", root: str | None = None) -> DataFrame:
    """Drain a stream into a table of the shared folder and return the table.

    A given ``root`` resumes from its checkpoint.
    """
    spark = stream.sparkSession
    root = root or fresh_path(spark, name)
    start_to_table(stream, root, mode).awaitTermination()
    return read_table(spark, root, stream.schema, mode)


TOTALS = "url string, variable string, type string, bucket string, n bigint, total double"


def start_metrics(
    events: DataFrame, to_stats: Callable[[DataFrame], DataFrame], read_config: Callable[[], DataFrame], root: str,
    trigger: Mapping[str, object] = DRAIN,
) -> StreamingQuery:
    """Start running metrics; ``read_table(spark, root, TOTALS, folder="totals")`` reads them at any time.

    The configuration is read anew for every batch, so a changed one applies from
    the next batch on.  Each batch adds its own counts to the totals of the batch
    before it and writes them as a new small table; earlier ones are dropped.  A
    batch that runs again starts from the same totals.
    """
    spark = events.sparkSession

    def fold(batch: DataFrame, batch_id: int) -> None:
        part = running_metrics(to_stats(batch), read_config())
        if batch_id:
            part = part.unionByName(spark.read.parquet(f"{root}/totals/batch={batch_id - 1}").select(*part.columns))
        totals = part.groupBy("url", "variable", "type", "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        totals.write.mode("overwrite").parquet(f"{root}/totals/batch={batch_id}")
        drop_before(spark, f"{root}/totals", batch_id - 1)

    return start_batches(events, fold, root, trigger)


def metrics_stream(
    events: DataFrame, to_stats: Callable[[DataFrame], DataFrame], read_config: Callable[[], DataFrame],
    name: str = "metrics", root: str | None = None,
) -> DataFrame:
    """Drain a stream of events into running metrics and return the totals so far."""
    spark = events.sparkSession
    root = root or fresh_path(spark, name)
    start_metrics(events, to_stats, read_config, root).awaitTermination()
    newest = latest_batch(spark, f"{root}/totals")
    return spark.read.parquet(newest) if newest else spark.createDataFrame([], TOTALS)


def auto_register_endpoints(stats: DataFrame, configured: DataFrame) -> DataFrame:
    """Urls to add with the default configuration (reserved variables only)."""
    return auto_registered(stats, configured).withColumn("auto_added", F.lit(True))
