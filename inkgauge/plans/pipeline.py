"""The batch feature job: balanced sample, features, scaled groups, written version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import LEXICON_CATEGORIES, READABILITY_FEATURES, TEXT_FEATURES, TREE_FEATURES
from ..operators.sampling import sample_per_label_replace
from ..operators.scaling import scale_feature_groups
from ..session import written
from ..sources.sinks import write_dataset_version
from .feature_table import feature_table

# Column groups that are scaled by a scaler of their own.
GROUPS = {
    "readability": (*READABILITY_FEATURES, *TEXT_FEATURES, "semantic_flow_variability"),
    "lexicon": LEXICON_CATEGORIES,
    "tree": TREE_FEATURES,
}


def balanced_features(
    essays: DataFrame, lexicon: DataFrame, familiar: DataFrame, per_label: int = 500, seed: int = 42,
    label: str = "label", key: str = "doc_id", categories: Sequence[str] = LEXICON_CATEGORIES,
) -> DataFrame:
    """Features of ``per_label`` draws with replacement per label.

    A text drawn twice is measured once: features are computed on the distinct
    texts and joined back to the draws.
    """
    draws = written(
        sample_per_label_replace(essays.where(F.col("text").isNotNull()), per_label, seed, label, key), "draws"
    )
    texts = draws.select(key, "text").dropDuplicates([key])
    features = feature_table(texts, lexicon, familiar, categories, key, with_flow=True)
    return draws.drop("text").join(features, key)


def features_pipeline(
    essays: DataFrame, lexicon: DataFrame, familiar: DataFrame, root: str, name: str, scale: bool = True, **options
) -> int:
    """Run the whole job and write it as the next version of ``name``.

    The feature rows are written before the scalers are fitted, so texts are
    measured once.  The scalers are written next to the data as ``name-scalers``.
    """
    rows = written(balanced_features(essays, lexicon, familiar, **options), "features")
    if not scale:
        return write_dataset_version(rows, root, name, "features per draw", ["features"])
    scaled, scalers = scale_feature_groups(rows, GROUPS)
    tables = [s.withColumn("group", F.lit(g)) for g, s in scalers.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    write_dataset_version(out, root, f"{name}-scalers", "min-max scalers by group", ["scaler"])
    return write_dataset_version(scaled, root, name, "scaled features per draw", ["features", "scaled"])
