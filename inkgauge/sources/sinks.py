"""Dataset versions, submissions and the model registry."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import commit, commit_numbered, read_entries

MANIFEST_SCHEMA = "name string, version int, path string, description string, tags array<string>, created timestamp"
REGISTRY_SCHEMA = "model_id string, name string, path string, tags array<string>, updated timestamp"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The committed versions of all datasets under ``root``."""
    return read_entries(spark, f"{root}/manifest", MANIFEST_SCHEMA)


def write_dataset_version(
    df: DataFrame, root: str, name: str, description: str = "", tags: Sequence[str] = ()
) -> int:
    """Write an immutable version of a dataset and commit it to the manifest.

    The data is whole in a folder of its own before a number is taken for it, so a
    lost write lists nothing.  A number is one log entry that only one writer can
    put; another writer goes on to the next.
    """
    spark = df.sparkSession
    path = f"{root}/{name}/data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    last = read_manifest(spark, root).where(F.col("name") == name).agg(F.max("version")).first()[0]
    entry = {"name": name, "path": path, "description": description, "tags": list(tags), "created": _now()}
    return commit_numbered(spark, f"{root}/manifest", name, last or 0, entry)


def read_dataset_version(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A version by number, the latest by default."""
    listed = read_manifest(spark, root).where(F.col("name") == name)
    if version is not None:
        listed = listed.where(F.col("version") == version)
    row = listed.orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"no version of dataset {name!r}")
    return spark.read.parquet(row["path"])


def write_submission(df: DataFrame, path: str) -> None:
    """``id, generated`` as CSV with a header."""
    df.select("id", "generated").write.mode("overwrite").csv(path, header=True)


def save_model(model: PipelineModel, root: str, model_id: str, name: str, tags: Sequence[str] = ()) -> str:
    """Persist a fitted pipeline in a folder of its own, then commit its registry row."""
    spark = SparkSession.active()
    path = f"{root}/models/{model_id}-{uuid.uuid4().hex}"
    model.write().save(path)
    commit(spark, f"{root}/registry", {"model_id": model_id, "name": name, "path": path, "tags": list(tags), "updated": _now()})
    return path


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    return read_entries(spark, f"{root}/registry", REGISTRY_SCHEMA)


def load_model(spark: SparkSession, root: str, model_id: str) -> PipelineModel:
    row = read_registry(spark, root).where(F.col("model_id") == model_id).orderBy(F.desc("updated")).first()
    if row is None:
        raise ValueError(f"no model {model_id!r}")
    return PipelineModel.load(row["path"])
