"""Version tables kept in step with a stream of model snapshots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import assign_versions, sync_versions
from ..session import fresh_path
from .metrics import DRAIN, read_table, start_batches

VERSIONS = "base_url string, version bigint, model_id bigint"


def next_versions(current: DataFrame, models: DataFrame, max_versions: int | None) -> DataFrame:
    """The served table after one snapshot of models."""
    wanted = assign_versions(models, current, max_versions)
    return sync_versions(current, wanted).where("action <> 'removed'").select("base_url", "version", "model_id")


def start_version_sync(
    models: DataFrame, max_versions: int | None, root: str, trigger: Mapping[str, object] = DRAIN
) -> StreamingQuery:
    """Start applying ``base_url, model_id, updated`` batches, each a new snapshot.

    Every batch writes a whole new table next to the one it read, so a batch
    that runs again starts from the same state.
    """
    spark = models.sparkSession

    def state(batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], VERSIONS)
        return spark.read.schema(VERSIONS).parquet(f"{root}/table/batch={batch_id - 1}")

    def apply(batch: DataFrame, batch_id: int) -> None:
        path = f"{root}/table/batch={batch_id}"
        next_versions(state(batch_id), batch, max_versions).write.mode("overwrite").parquet(path)

    return start_batches(models, apply, root, trigger)


def version_sync(
    models: DataFrame, max_versions: int | None, name: str = "versions", root: str | None = None
) -> DataFrame:
    """Drain a stream of snapshots and return the served table; a given ``root`` resumes."""
    spark = models.sparkSession
    root = root or fresh_path(spark, name)
    start_version_sync(models, max_versions, root).awaitTermination()
    return read_table(spark, root, VERSIONS, folder="table")
