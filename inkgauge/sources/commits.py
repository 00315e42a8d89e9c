"""A log of small JSON entries in a folder, each put there once or not at all."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping
from typing import Any
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call put the file there; of several callers one does.

    On a folder of the machine the whole file is linked to its name, which fails
    where there is one.  Elsewhere the file system creates it without overwriting.
    """
    hadoop, fs = file_system(spark, path)
    if fs.getUri().getScheme() == "file":
        target = hadoop.toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        draft = f"{os.path.dirname(target)}/_{uuid.uuid4().hex}"
        with open(draft, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        out = fs.create(hadoop, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


def read_entries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The entries of a log; none where there is no folder yet.

    A file that a lost writer has left without its whole line is no entry.
    """
    hadoop, fs = file_system(spark, folder)
    if not fs.exists(hadoop):
        return spark.createDataFrame([], schema)
    required = schema.split(" ", 1)[0]
    return spark.read.schema(schema).json(folder).where(f"{required} is not null")


def commit_numbered(spark: SparkSession, folder: str, name: str, last: int, entry: Mapping[str, Any]) -> int:
    """Puts ``entry`` under the next free number of ``name`` after ``last`` and returns that number."""
    number = last + 1
    while not put_if_absent(spark, f"{folder}/{quote(name, safe='')}-{number}.json", json.dumps({**entry, "version": number}) + "\n"):
        number += 1
    return number


def commit(spark: SparkSession, folder: str, entry: Mapping[str, Any]) -> None:
    """Puts ``entry`` under a name of its own."""
    put_if_absent(spark, f"{folder}/{uuid.uuid4().hex}.json", json.dumps(dict(entry)) + "\n")
