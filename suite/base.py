"""Registry of queries, table access and rounding shared by all query files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its equivalent on the same tables."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def r6(c: Column | str, name: str | None = None) -> Column:
    """A double rounded to six places, as the SQL side does."""
    col = F.col(c) if isinstance(c, str) else c
    # adding 0.0 turns a rounded -0.0 into 0.0
    out = F.round(col.cast("double"), 6) + F.lit(0.0)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def big(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = col.cast("bigint")
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def essays(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled essays: documents with ``quality`` as the label."""
    docs = table(spark, sf, "documents", "doc_id", "text", "source")
    labels = table(spark, sf, "labels", "doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, label, prediction, score`` from rules over the documents."""
    docs = table(spark, sf, "documents", "doc_id", "n_chars")
    labels = table(spark, sf, "labels", "doc_id", F.col("quality").alias("label"), "toxic")
    score = F.least(F.lit(1.0), F.floor(F.col("n_chars") / F.lit(40.0)) / F.lit(100.0))
    return docs.join(labels, "doc_id").select(
        "doc_id", "label", (1 - F.col("toxic")).alias("prediction"), score.alias("score")
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scored requests: the type is the url, value/100 the latency."""
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("event_type").alias("url"), (F.col("value") / 100).alias("latency"), "value", "props"
    )


# -- SQL fragments ----------------------------------------------------------

ESSAYS_SQL = "(SELECT d.doc_id, d.text, d.source, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"

PREDICTIONS_SQL = (
    "(SELECT d.doc_id, l.quality AS label, 1 - l.toxic AS prediction, "
    "least(1.0::DOUBLE, floor(d.n_chars / 40.0::DOUBLE) / 100.0::DOUBLE) AS score "
    "FROM documents d JOIN labels l USING (doc_id))"
)

REQUESTS_SQL = (
    "(SELECT event_id, ts, event_type AS url, value / 100 AS latency, value, props FROM events)"
)


def draw_hex_sql(key: str, seed: int | str) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


def draw_sql(key: str, seed: int | str) -> str:
    return f"(('0x' || substr({draw_hex_sql(key, seed)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
