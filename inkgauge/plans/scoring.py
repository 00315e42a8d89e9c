"""Scoring a table or stream of text requests: route, resolve, clean, score, interpret."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..fixed import FEATURES
from ..functions import text as X
from ..functions.vectors import argmax, positive_score
from ..operators.config import resolve_endpoint
from ..operators.frame import interpret_score
from ..operators.routing import route_canary
from ..operators.scaling import minmax_transform
from ..operators.tokens import encode_tokens
from ..session import fresh_path, spread, written
from ..sources.stats import pack_batches
from ..streaming.metrics import DRAIN, start_batches
from ..streaming.requests import request_stats, sample_stream
from .feature_table import cleaned, feature_table


def score_requests(
    requests: DataFrame, targets: DataFrame, static: DataFrame, monitored: DataFrame, score: Column, seed: int,
    key: str = "request_id",
) -> DataFrame:
    """``requests(key, url, text)`` with ``routed, model_id, clean, score, verdict``.

    ``score`` is an expression over the row and its ``clean`` text.  All joins
    are with small configuration tables, so a request never leaves its task.
    Requests without an endpoint drop out: ``config.unresolved`` lists them.
    """
    routed = route_canary(requests, targets, seed, key)
    asked = routed.withColumnsRenamed({"url": "asked", "routed": "url"})
    found = resolve_endpoint(asked, static, monitored).where(F.col("model_id").isNotNull())
    cleaned = found.withColumn("clean", X.clean_text("text", order="serving"))
    scored = cleaned.withColumn("score", score).withColumnsRenamed({"url": "routed", "asked": "url"})
    return scored.withColumn("verdict", interpret_score("score"))


def _numbered(requests: DataFrame) -> DataFrame:
    """The requests, read once, with a number ``_row`` for each: keys may repeat or be null."""
    return written(requests.withColumn("_row", F.monotonically_increasing_id()), "requests")


def _features(rows: DataFrame, lexicon: DataFrame, familiar: DataFrame, key: str, order: str, tables: Mapping[str, DataFrame | None], clean: DataFrame | None = None) -> DataFrame:
    """The feature table of numbered requests by ``_row``; tables by ``key`` are brought to it."""
    known = {k: t for k, t in tables.items() if t is not None}
    for name in ("annotations", "vectors"):
        if name in known:
            of = rows.select(F.col(key).alias("_of"), "_row")
            known[name] = known[name].join(of, F.col(key).eqNullSafe(F.col("_of"))).drop(key, "_of")
    return feature_table(rows.select("_row", "text"), lexicon, familiar, key="_row", order=order, clean=clean, **known)


def score_features(
    requests: DataFrame, lexicon: DataFrame, familiar: DataFrame, predict: Callable[[DataFrame], DataFrame],
    key: str = "request_id", **tables: DataFrame | None,
) -> DataFrame:
    """Score texts by their features: adds ``score``, ``verdict`` and a ``features`` map.

    ``predict`` takes the feature table and adds ``score``: an expression, a
    fitted pipeline's transform or an additive model.  ``annotations, lemmas, tags``
    and ``vectors`` are those of ``feature_table``, so that scored features are those a
    model was trained on.  Every request has a row, whether its key repeats or is null.
    """
    rows = _numbered(requests)
    scored = predict(_features(rows, lexicon, familiar, key, "batch", tables))
    names = [f for f in FEATURES if f in scored.columns]
    values = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))
    reply = scored.select("_row", "score", values.alias("features"))
    return rows.drop("text").join(reply, "_row").drop("_row").withColumn("verdict", interpret_score("score"))


def score_reply(
    requests: DataFrame, vocab: DataFrame, logits: Callable[[DataFrame], DataFrame], lexicon: DataFrame, familiar: DataFrame,
    scaler: DataFrame | None = None, key: str = "request_id", max_length: int = 128, **tables: DataFrame | None,
) -> DataFrame:
    """One reply per request: ``key, label, probability, features``.

    The text is cleaned as in serving and encoded to ``input_ids``; ``logits``
    (an expression, an engine or a fitted model over the ids) adds a column of
    that name: its largest gives the label, ``positive_score`` the probability.  The
    features of the same text come as a map; those a saved ``scaler`` names are
    min-max scaled by it.  ``annotations, lemmas, tags`` and ``vectors`` are those of
    ``feature_table``.  Serves a table as well as each batch of a stream; every request
    has a reply, whether its key repeats or is null.
    """
    rows = _numbered(requests.select(key, "text"))
    clean = written(cleaned(spread(rows.select("_row", "text"), "_row"), "_row", "text", "serving"), "clean")
    ids = encode_tokens(clean, vocab, max_length, "_row", "clean")
    scored = logits(ids).select("_row", argmax("logits").alias("label"), positive_score("logits").alias("probability"))
    # the ids take the suffix rule; only a lemma table asks for another cleaning
    table = _features(rows, lexicon, familiar, key, "serving", tables, clean if tables.get("lemmas") is None else None)
    names = [f for f in FEATURES if f in table.columns]
    known = {r["col"] for r in scaler.select("col").collect()} if scaler is not None else set()
    scaled = [f for f in names if f in known]
    if scaled:
        table = minmax_transform(table, scaler, scaled)
    values = [F.col(f"{f}_scaled" if f in known else f).cast("double") for f in names]
    features = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*values))
    replies = scored.join(table.select("_row", features.alias("features")), "_row")
    return rows.select("_row", key).join(replies, "_row").drop("_row")


def start_reply_stream(
    requests: DataFrame, reply: Callable[[DataFrame], DataFrame], root: str, trigger: Mapping[str, object] = DRAIN
) -> StreamingQuery:
    """Start replying to a stream: ``reply`` (``score_reply`` with its tables) on every batch, under ``root/replies``."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        reply(batch).write.mode("overwrite").parquet(f"{root}/replies/batch={batch_id}")

    return start_batches(requests, apply, root, trigger)


def score_stream(
    requests: DataFrame, targets: DataFrame, static: DataFrame, monitored: DataFrame, score: Column, seed: int,
    freq: float = 1.0, key: str = "request_id", max_bytes: int = 1_000_000, root: str | None = None,
) -> str:
    """Drain a stream of requests through ``start_score_stream``; returns the root with ``scored`` and ``messages``."""
    root = root or fresh_path(requests.sparkSession, "scoring")
    start_score_stream(requests, targets, static, monitored, score, seed, root, freq, key, max_bytes).awaitTermination()
    return root


def start_score_stream(
    requests: DataFrame, targets: DataFrame, static: DataFrame, monitored: DataFrame, score: Column, seed: int, root: str,
    freq: float = 1.0, key: str = "request_id", max_bytes: int = 1_000_000, trigger: Mapping[str, object] = DRAIN,
) -> StreamingQuery:
    """Start scoring a stream of ``key, url, text, latency`` and reporting its statistics.

    Every batch writes its scored rows, then derives statistics messages from
    the rows just written, so a text is scored once for both sinks.  Folders are
    named by batch, so a repeated batch overwrites itself.
    """
    spark = requests.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        path = f"{root}/scored/batch={batch_id}"
        score_requests(batch, targets, static, monitored, score, seed, key).write.mode("overwrite").parquet(path)
        done = spark.read.parquet(path)
        logged = sample_stream(done, F.lit(freq), key, f"{seed}:log")
        verdict = F.create_map(F.lit("verdict"), F.coalesce(F.col("verdict"), F.lit("")))
        stats = request_stats(
            logged.withColumn("_reply", verdict), url="routed", freq=F.lit(freq), response="_reply",
            metric_keys=F.array(F.lit("verdict")),
        )
        fields = ["_url", "_latency", "_count", "verdict"]
        events = stats.select(key, *[F.col("stats")[f].alias(f) for f in fields])
        messages = pack_batches(events, key, max_bytes, fields)
        messages.select("message").write.mode("overwrite").text(f"{root}/messages/batch={batch_id}")

    return start_batches(requests, apply, root, trigger)
