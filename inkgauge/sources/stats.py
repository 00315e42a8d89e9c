"""Statistics messages: JSON arrays of flat events, packed and unpacked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.base import draw

MESSAGE = "array<map<string,string>>"


def read_stats_stream(spark: SparkSession, source: str, options: Mapping[str, str]) -> DataFrame:
    """Raw messages as a stream with the column ``value``.

    ``source='kafka'`` passes the options on to the connector; any file format
    name reads new files of ``options['path']``.
    """
    opts = dict(options)
    if source == "kafka":
        raw = spark.readStream.format("kafka").options(**opts).load()
        return raw.select(F.col("value").cast("string").alias("value"))
    path = opts.pop("path")
    return spark.readStream.format("text").options(**opts).load(path)


def unpack_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """One map per event.  A message that does not parse and an event without ``_url`` are skipped."""
    return (
        messages.select(F.explode(F.from_json(value, MESSAGE)).alias("event"))
        .where(F.coalesce(F.try_element_at("event", F.lit("_url")), F.lit("")) != "")
    )


def event_variables(events: DataFrame) -> DataFrame:
    """``url, variable, value`` rows of the event maps; a JSON list gives one row per element."""
    rows = events.select(
        F.try_element_at("event", F.lit("_url")).alias("url"),
        F.explode(F.map_filter("event", lambda k, _v: k != "_url")).alias("variable", "raw"),
    )
    values = F.when(F.col("raw").startswith("["), F.from_json("raw", "array<string>")).otherwise(F.array("raw"))
    return rows.select("url", "variable", F.explode(values).alias("value"))


def pack_batches(
    df: DataFrame, key: str, max_bytes: int, columns: Sequence[str] | None = None, blocks: int | None = None,
    block_bytes: int = 64 * 1024 * 1024,
) -> DataFrame:
    """``block, chunk, n, bytes, message``: JSON arrays that stay within ``max_bytes``.

    Rows are dealt to blocks by a seeded draw, so no block depends on a hot key.
    Inside a block a running size cuts chunks; the stride leaves room for the
    longest row, hence a message exceeds the limit only if one event alone does.
    Without ``blocks`` their number follows from the size of the data, about ``block_bytes`` each.
    """
    blocks = blocks or blocks_for(df, columns, block_bytes)
    body = F.to_json(F.struct(*(columns or df.columns)))
    # every row costs its text and a comma, the message two brackets
    rows = df.select(key, body.alias("_json"), F.floor(draw(key, "pack") * blocks).alias("block")).withColumn(
        "_len", F.octet_length("_json").cast("bigint") + 1
    )
    longest = F.max("_len").over(Window.partitionBy("block"))
    w = Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    stride = F.greatest(F.lit(max_bytes - 1) - longest, F.lit(1))
    cut = rows.withColumn("_before", F.coalesce(F.sum("_len").over(w), F.lit(0))).withColumn(
        "chunk", F.floor(F.col("_before") / stride)
    )
    packed = cut.groupBy("block", "chunk").agg(
        F.count("*").alias("n"),
        (F.sum("_len") + 1).alias("bytes"),
        F.sort_array(F.collect_list(F.struct(key, "_json"))).alias("_rows"),
    )
    message = F.concat(F.lit("["), F.array_join("_rows._json", ","), F.lit("]"))
    return packed.select("block", "chunk", "n", "bytes", message.alias("message"))


def write_messages(packed: DataFrame, sink: str, options: Mapping[str, str]) -> None:
    """Send packed messages to Kafka, or to any file format under ``options['path']``."""
    opts = dict(options)
    rows = packed.select(F.col("message").alias("value"))
    if sink == "kafka":
        rows.write.format("kafka").options(**opts).save()
    else:
        path = opts.pop("path")
        rows.write.format(sink).mode("append").options(**opts).save(path)


def blocks_for(df: DataFrame, columns: Sequence[str] | None = None, block_bytes: int = 64 * 1024 * 1024) -> int:
    """How many blocks keep each one near ``block_bytes``."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*(columns or df.columns)))))).first()[0] or 0
    return max(1, -(-int(size) // block_bytes))
