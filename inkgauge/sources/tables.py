"""Typed scans of labelled texts, requests and metric text."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED_SCHEMA = "text string, label int, source string"

# Fixed value: the line format of the scraped metric text.
METRIC_LINE = r'^(\w+)\{(gpu_uuid="[^"]*",)?model="(\w+)",\s*version="([0-9]+)"\}\s*([0-9.]*)'


def scan_csv_union(spark: SparkSession, glob: str, columns: Sequence[str], multi_line: bool = True) -> DataFrame:
    """Every CSV file of a glob, united by column name with null fill.

    Only the first line of a file is read to learn its header; files with the
    same header then form one scan.  All columns are text: casts follow where
    needed.  Texts with line breaks need ``multi_line``, which keeps a file in
    one task; without it large files are split.
    """

    def read(paths: list[str]) -> DataFrame:
        return spark.read.csv(paths, header=True, multiLine=multi_line, escape='"', inferSchema=False)

    files = [r["path"] for r in spark.read.format("binaryFile").load(glob).select("path").toLocalIterator()]
    files.sort()
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda path: tuple(read([path]).columns), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in zip(files, headers):
        groups.setdefault(header, []).append(path)
    out = None
    for paths in groups.values():
        df = read(paths)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no files match {glob}")
    missing = [c for c in columns if c not in out.columns]
    return out.withColumns({c: F.lit(None).cast("string") for c in missing}).select(*columns)


def scan_labelled(spark: SparkSession, path: str) -> DataFrame:
    """``text, label, source`` with rows holding any null dropped, then cast."""
    return typed_labelled(spark.read.parquet(path))


def typed_labelled(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Nulls go before the cast, so a missing text never becomes a word."""
    return df.select(*keep, "text", "label", "source").na.drop("any").select(
        *keep,
        F.col("text").cast("string").alias("text"),
        F.col("label").try_cast("int").alias("label"),
        F.col("source").cast("string").alias("source"),
    )


def read_requests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON request bodies (plain or gzip); a missing key is null."""
    return spark.read.schema(schema).json(path)


def parse_requests(df: DataFrame, body: str, schema: str, out: str = "request") -> DataFrame:
    """The same for bodies held in a text column; a malformed body gives nulls."""
    return df.withColumn(out, F.from_json(F.col(body), schema))


def scan_metrics_text(df: DataFrame, line: str = "value") -> DataFrame:
    """``metric, model, version, series, value`` from metric lines.

    Comments and lines that do not parse are skipped; the gpu id is optional.
    """
    text = F.trim(F.col(line))

    def part(i: int):
        return F.regexp_extract(text, METRIC_LINE, i)

    return (
        df.where(F.length(text) > 0)
        .where(~text.startswith("#"))
        .where(text.rlike(METRIC_LINE))
        .select(
            part(1).alias("metric"),
            part(3).alias("model"),
            part(4).alias("version"),
            F.concat(part(3), F.lit(".v"), part(4)).alias("series"),
            part(5).try_cast("double").alias("value"),
        )
        .where("value IS NOT NULL")
    )


# Serving dtypes and the Spark types that hold them.
DTYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
}


def tensor_schema(names: Sequence[str], dtypes: Sequence[str], dims: Sequence[Sequence[int]]) -> T.StructType:
    """Columns for declared tensors: one array level per dimension."""
    fields = []
    for name, dtype, dim in zip(names, dtypes, dims):
        kind = DTYPES[dtype]
        for _ in dim:
            kind = T.ArrayType(kind)
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)
