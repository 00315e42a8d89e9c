"""Histograms, gauges, counters and the statistics streams (A14-A18, A22, S5, S11, M1-M10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.fixed import LATENCY_BOUNDS
from inkgauge.operators import config as C
from inkgauge.operators import histograms as H
from inkgauge.operators import routing
from inkgauge.session import fresh_path
from inkgauge.sources import stats
from inkgauge.streaming import metrics as M
from inkgauge.streaming import requests as Q
from inkgauge.streaming import versions as V

from .base import big, draw_sql, query, r6, requests, table
from .frame_queries import (
    ASSIGN, METRIC_CFG, ORDERS_SQL, STATS_ROWS, metric_cfg, models, stats_rows,
)

INF = "'Infinity'::DOUBLE"


def first_bound_sql(value: str, bounds) -> str:
    cases = " ".join(f"WHEN {value} <= {b} THEN {float(b)}::DOUBLE" for b in bounds)
    return f"CASE {cases} ELSE {INF} END"


BOUNDS_SQL = "(VALUES " + ", ".join(f"({b}::DOUBLE)" for b in LATENCY_BOUNDS) + f", ({INF})) b(le)"


def hist_sql(bounds, value: str) -> str:
    rows = "(VALUES " + ", ".join(f"({float(b)}::DOUBLE)" for b in bounds) + f", ({INF})) b(le)"
    return f"""WITH x AS (SELECT event_type AS url, {first_bound_sql(value, bounds)} AS le FROM events),
t AS (SELECT url, count(*) AS total FROM x GROUP BY url), c AS (SELECT url, le, count(*) AS n FROM x GROUP BY ALL)
SELECT t.url, b.le::VARCHAR AS le, coalesce(c.n, 0)::BIGINT AS n, t.total FROM t CROSS JOIN {rows} LEFT JOIN c ON c.url = t.url AND c.le = b.le"""


def le_text(df):
    """Bounds as text: both engines print infinity their own way."""
    return df.withColumn("le", F.when(F.col("le") == H.INF, F.lit("inf")).otherwise(F.col("le").cast("string")))


@query("a14_scalar_histogram", hist_sql([1, 5, 10, 50, 100, 200], "value"))
def a14(spark, sf):
    out = H.scalar_histogram(requests(spark, sf), [1, 5, 10, 50, 100, 200])
    return le_text(out).select("url", "le", big("n"), "total")


@query("a18_latency_histogram", hist_sql(LATENCY_BOUNDS, "value / 100"))
def a18(spark, sf):
    return le_text(H.latency_histogram(requests(spark, sf))).select("url", "le", big("n"), "total")


ENUM = ["click", "purchase", "view"]


@query(
    "a15_enum_histogram",
    """WITH t AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type NOT IN ('click', 'purchase', 'view')) AS unknown FROM events GROUP BY user_id)
SELECT t.user_id, v.enum, (SELECT count(*) FROM events e WHERE e.user_id = t.user_id AND e.event_type = v.enum) AS n, total, unknown
FROM t CROSS JOIN (VALUES ('click'), ('purchase'), ('view')) v(enum)""",
)
def a15(spark, sf):
    return H.enum_histogram(table(spark, sf, "events"), ENUM, "event_type", ["user_id"])


@query("a16_gauge_last", "SELECT event_type AS url, arg_max(value, {'ts': ts, 'id': event_id}) AS value FROM events GROUP BY event_type")
def a16(spark, sf):
    return H.gauge_last(requests(spark, sf))


@query(
    "a17_counter_total",
    "SELECT event_type AS url, sum(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'error' THEN 0 ELSE 4 END)::BIGINT AS total FROM events GROUP BY event_type",
)
def a17(spark, sf):
    freq = F.when(F.col("url") == "click", 0.4).when(F.col("url") == "view", 1.0).when(F.col("url") == "error", 2.0).otherwise(0.25)
    return H.counter_total(requests(spark, sf), H.scaled_count(freq))


SHARES = f"""c AS (SELECT date_trunc('minute', ts) AS w, event_type AS url, {first_bound_sql('value / 100', LATENCY_BOUNDS)} AS bucket, count(*) AS n FROM events GROUP BY ALL)"""


@query(
    "a22_bucket_share_over_time",
    f"""WITH {SHARES} SELECT epoch(w)::BIGINT AS window_start, url, CASE WHEN bucket = {INF} THEN 'inf' ELSE bucket::VARCHAR END AS bucket, n,
  round(100.0 * n / sum(n) OVER (PARTITION BY w, url), 6) AS share FROM c""",
)
def a22(spark, sf):
    out = H.bucket_share_over_time(requests(spark, sf), H.first_bound("latency", LATENCY_BOUNDS))
    b = F.when(F.col("bucket") == H.INF, "inf").otherwise(F.col("bucket").cast("string"))
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "url", b.alias("bucket"), "n", r6("share"))


@query(
    "s11_to_metric_samples",
    f"""WITH h AS ({hist_sql(LATENCY_BOUNDS, 'value / 100')}), l AS (SELECT *, CASE WHEN le = 'inf' THEN '+Inf' ELSE le END AS label_value FROM h)
SELECT url || '_bucket' AS metric, 'le' AS label, label_value, n::DOUBLE AS value FROM l
UNION ALL SELECT url || '_sum', 'le', label_value, total::DOUBLE FROM l""",
)
def s11(spark, sf):
    return H.to_metric_samples(H.latency_histogram(requests(spark, sf)), keys=["url"])


@query(
    "f5_metric_classes",
    "SELECT 'scalar' AS kind, count(DISTINCT event_type) * 3 AS n FROM events UNION ALL SELECT 'enum', count(DISTINCT event_type) * 2 FROM events UNION ALL SELECT 'value', count(DISTINCT event_type) FROM events UNION ALL SELECT 'counter', count(DISTINCT event_type) FROM events",
)
def f5(spark, sf):
    reqs = requests(spark, sf).withColumn("k", F.get_json_object("props", "$.k"))
    parts = {
        "scalar": H.aggregate_metric("scalar", reqs, bounds=[1.0, 2.0], value="latency"),
        "enum": H.aggregate_metric("enum", reqs, enum=["1", "2"], value="k"),
        "value": H.aggregate_metric("value", reqs),
        "counter": H.aggregate_metric("counter", reqs, amount="value"),
    }
    out = None
    for kind, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "f5b_metric_values",
    """WITH e AS (SELECT event_type AS url, value / 100 AS latency, value, json_extract_string(props, '$.k') AS k, ts, event_id FROM events)
SELECT 'scalar' AS kind, url, b.cell, count(*) FILTER (WHERE latency > b.lo AND latency <= b.hi)::DOUBLE AS n
  FROM e JOIN (VALUES ('1.0', '-Infinity'::DOUBLE, 1.0::DOUBLE), ('2.0', 1.0, 2.0), ('Infinity', 2.0, 'Infinity'::DOUBLE)) b(cell, lo, hi) ON true WHERE latency IS NOT NULL GROUP BY url, b.cell
UNION ALL SELECT 'enum', url, v.cell, count(*) FILTER (WHERE k = v.cell) FROM e JOIN (VALUES ('1'), ('2')) v(cell) ON true WHERE k IS NOT NULL GROUP BY url, v.cell
UNION ALL SELECT 'value', url, '', arg_max(value, {'ts': ts, 'id': event_id}) FROM e GROUP BY url
UNION ALL SELECT 'counter', url, '', round(sum(value), 4) FROM e GROUP BY url""",
)
def f5b(spark, sf):
    """What every metric class makes of its values."""
    reqs = requests(spark, sf).withColumn("k", F.get_json_object("props", "$.k"))
    none = F.lit("")
    parts = [
        ("scalar", H.aggregate_metric("scalar", reqs, bounds=[1.0, 2.0], value="latency"), F.col("le").cast("string"), F.col("n")),
        ("enum", H.aggregate_metric("enum", reqs, enum=["1", "2"], value="k"), F.col("enum"), F.col("n")),
        ("value", H.aggregate_metric("value", reqs), none, F.col("value")),
        ("counter", H.aggregate_metric("counter", reqs, amount="value"), none, F.round("total", 4)),
    ]
    out = [df.select(F.lit(kind).alias("kind"), "url", cell.alias("cell"), n.cast("double").alias("n")) for kind, df, cell, n in parts]
    return reduce(DataFrame.unionAll, out)


# -- requests ---------------------------------------------------------------

FREQ_SQL = "CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.0 WHEN 'error' THEN 2.0 ELSE 0.1 END"


def freq():
    u = F.col("url")
    return F.when(u == "click", 0.5).when(u == "view", 0.0).when(u == "error", 2.0).otherwise(0.1)


@query("m2_sample_stream", f"SELECT event_id, event_type AS url FROM events WHERE {FREQ_SQL} > 0 AND ({FREQ_SQL} >= 1 OR {draw_sql('event_id', 7)} <= {FREQ_SQL})")
def m2(spark, sf):
    return Q.sample_stream(requests(spark, sf), freq(), "event_id", 7).select("event_id", "url")


@query(
    "m2b_sampled_counts",
    f"""WITH e AS (SELECT event_id, event_type AS url, CASE event_type WHEN 'click' THEN 0.4::DOUBLE WHEN 'view' THEN 0.0 WHEN 'error' THEN 2.0 ELSE 0.25 END AS f FROM events)
SELECT url, count(*) AS logged, sum(floor(1.0 / f))::BIGINT AS estimated FROM e WHERE f > 0 AND (f >= 1 OR {draw_sql('event_id', 8)} <= f) GROUP BY url""",
)
def m2b(spark, sf):
    """Logged requests per endpoint and the requests they stand for."""
    cfg = spark.createDataFrame([("click", 0.4), ("view", 0.0), ("error", 2.0), ("signup", None)], "url string, log_frequency double")
    rows = Q.sample_stream(Q.with_frequency(requests(spark, sf), cfg, 0.25), "log_frequency", "event_id", 8)
    return rows.groupBy("url").agg(F.count("*").alias("logged"), F.sum(H.scaled_count("log_frequency")).alias("estimated"))


@query(
    "m1_request_stats",
    """SELECT event_id, round(value / 700, 4) AS latency, '2' AS n, event_type AS url, CASE WHEN event_type = 'error' THEN '-1' ELSE json_extract_string(props, '$.k') END AS k,
  event_type AS verdict, 'c' AS extra FROM events""",
)
def m1(spark, sf):
    reqs = requests(spark, sf).select(
        "event_id", "url", (F.col("value") / 700).alias("latency"), F.from_json("props", "map<string,string>").alias("body"),
        F.map_filter(
            F.create_map(F.lit("verdict"), F.col("url"), F.lit("k"), F.when(F.col("url") == "error", "-1")), lambda _k, v: v.isNotNull()
        ).alias("reply"),
        F.create_map(F.lit("extra"), F.lit("c"), F.lit("verdict"), F.lit("old")).alias("own"),
    )
    out = Q.request_stats(
        reqs, freq=F.lit(0.4), request="body", response="reply", metric_keys=F.array(F.lit("k"), F.lit("verdict")), custom="own"
    )
    s = F.col("stats")
    return out.select(
        "event_id", s["_latency"].cast("double").alias("latency"), s["_count"].alias("n"), s["_url"].alias("url"),
        s["k"].alias("k"), s["verdict"].alias("verdict"), s["extra"].alias("extra"),
    )


# -- streams ----------------------------------------------------------------

def event_stream(spark, sf):
    """The events table as a file stream; the glob serves a file and a folder alike."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


BUCKET_SQL = f"""CASE WHEN s.variable = '_latency' THEN {first_bound_sql('s.value::DOUBLE', LATENCY_BOUNDS)}::VARCHAR
  WHEN type = 'scalar' THEN (CASE WHEN s.value::DOUBLE <= 10 THEN 10.0::DOUBLE WHEN s.value::DOUBLE <= 50 THEN 50.0 WHEN s.value::DOUBLE <= 90 THEN 90.0 ELSE {INF} END)::VARCHAR
  WHEN type = 'enum' THEN CASE WHEN s.value IN ('1', '2', '3') THEN s.value ELSE '__unknown__' END END"""
METRICS_SQL = f"""WITH s AS (
  SELECT s.url, s.variable, s.value, CASE s.variable WHEN '_latency' THEN 'scalar' WHEN '_count' THEN 'counter' ELSE c.type END AS type
  FROM {STATS_ROWS} s LEFT JOIN (VALUES {", ".join(f"('{u}', '{v}', '{t}')" for u, v, t, _b in METRIC_CFG)}) c(url, variable, type) ON c.url = s.url AND c.variable = s.variable
  WHERE s.variable IN ('_latency', '_count') OR c.type IS NOT NULL)
SELECT url, variable, type, replace({BUCKET_SQL}, 'inf', 'Infinity') AS bucket, count(*) AS n,
  sum(CASE WHEN type = 'counter' THEN s.value::DOUBLE END) AS total FROM s GROUP BY ALL"""


METRIC_KEYS = ["url", "variable", "type", "bucket"]


@query("m3_metrics_stream", METRICS_SQL)
def m3(spark, sf):
    M.use_rocksdb(spark)
    totals = M.running_metrics(stats_rows(event_stream(spark, sf)), metric_cfg(spark))
    return M.run_updates(totals, "m3", METRIC_KEYS)


@query("m3b_metrics_batch_twin", METRICS_SQL)
def m3b(spark, sf):
    return M.running_metrics(stats_rows(table(spark, sf, "events")), metric_cfg(spark))


@query("m5_config_reload", METRICS_SQL)
def m5(spark, sf):
    path = fresh_path(spark, "config")
    metric_cfg(spark).write.parquet(path)
    return M.metrics_stream(event_stream(spark, sf), stats_rows, lambda: spark.read.parquet(path), "m5")


EVEN = METRICS_SQL.replace("FROM events", "FROM (SELECT * FROM events WHERE event_id % 2 = 0) events")
ODD = METRICS_SQL.replace("FROM events", "FROM (SELECT * FROM events WHERE event_id % 2 = 1) events").replace(
    "WHERE s.variable IN ('_latency', '_count') OR c.type IS NOT NULL", "WHERE s.variable IN ('_latency', '_count')"
)


@query(
    "m5b_config_changed",
    f"SELECT url, variable, type, bucket, sum(n)::BIGINT AS n, sum(total) AS total FROM (({EVEN}) UNION ALL ({ODD})) GROUP BY ALL",
)
def m5b(spark, sf):
    """Half of the events, then a configuration without variables of its own, then the other half by the same stream."""
    root, path = fresh_path(spark, "m5b"), fresh_path(spark, "arriving")
    events = table(spark, sf, "events")
    configs = [metric_cfg(spark), metric_cfg(spark).limit(0)]
    for rest in (0, 1):
        events.where(F.col("event_id") % 2 == rest).write.mode("append").parquet(path)
        arriving = spark.readStream.schema(events.schema).parquet(path)
        out = M.metrics_stream(arriving, stats_rows, lambda now=configs[rest]: now, root=root)
    return out


@query(
    "m4_gauge_stream",
    f"""WITH r AS (SELECT ts, event_id, event_type AS url, json_extract_string(props, '$.k') AS k, user_id::VARCHAR AS user FROM events)
SELECT url, 'k' AS variable, arg_max(k, {{'ts': ts, 'id': event_id}}) AS value FROM r GROUP BY url
UNION ALL SELECT url, 'user', arg_max("user", {{'ts': ts, 'id': event_id}}) FROM r GROUP BY url""",
)
def m4(spark, sf):
    M.use_rocksdb(spark)
    rows = stats_rows(event_stream(spark, sf)).where(F.col("variable").isin("k", "user"))
    return M.run_updates(M.gauges(rows), "m4", ["url", "variable"])


@query("m6_auto_register_endpoints", "SELECT DISTINCT event_type AS url, true AS auto_added FROM events WHERE event_type NOT IN ('click', 'view', 'error', 'signup')")
def m6(spark, sf):
    return M.auto_register_endpoints(stats_rows(table(spark, sf, "events")), metric_cfg(spark))


CANARY = [("click", 1, "click/1", 0.5), ("click", 2, "click/2", 0.3), ("click", 3, "gone/1", 0.2), ("view", 1, "view/9", 0.25), ("view", 2, "view/10", 0.75)]
LIVE = [("click/1",), ("click/2",), ("view/9",), ("view/10",)]


@query(
    "m7_route_canary",
    f"""WITH u AS (SELECT event_id, event_type AS url, {draw_sql('event_id', 11)} AS u FROM events)
SELECT event_id, url, CASE WHEN url = 'click' THEN CASE WHEN u < 0.5::DOUBLE / (0.5::DOUBLE + 0.3::DOUBLE) THEN 'click/1' ELSE 'click/2' END
  WHEN url = 'view' THEN CASE WHEN u < 0.25 THEN 'view/9' ELSE 'view/10' END ELSE url END AS routed FROM u""",
)
def m7(spark, sf):
    canary = spark.createDataFrame(CANARY, "endpoint string, ord int, target string, weight double")
    targets = routing.existing_targets(canary, spark.createDataFrame(LIVE, "url string"))
    reqs = table(spark, sf, "events").select("event_id", F.col("event_type").alias("url"))
    return routing.route_canary(reqs, targets, 11, "event_id").select("event_id", "url", "routed")


NO_VERSIONS = "(SELECT NULL::VARCHAR AS base_url, NULL::BIGINT AS model_id, NULL::BIGINT AS version WHERE false)"


@query(
    "m8_version_sync",
    f"""WITH cur AS {NO_VERSIONS}, wanted AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY base_url ORDER BY updated DESC, model_id DESC) AS rn
  FROM {ORDERS_SQL}) WHERE rn <= 100), {ASSIGN}""",
)
def m8(spark, sf):
    path = fresh_path(spark, "snapshots")
    snapshot = models(spark, sf).select("base_url", "model_id", "updated")
    snapshot.write.parquet(path)
    return V.version_sync(spark.readStream.schema(snapshot.schema).parquet(path), 100, "m8")


def _newest(rows: str, n: int) -> str:
    return f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY base_url ORDER BY updated DESC, model_id DESC) AS rn FROM {rows}) WHERE rn <= {n})"""


@query(
    "m8b_removal_and_rollback",
    f"""WITH one AS (WITH cur AS {NO_VERSIONS}, wanted AS {_newest(ORDERS_SQL, 20)}, {ASSIGN}),
two AS (WITH cur AS (SELECT * FROM one), wanted AS {_newest(f"(SELECT * FROM {ORDERS_SQL} WHERE model_id % 3 <> 0)", 20)}, {ASSIGN}),
three AS (WITH cur AS (SELECT * FROM two), wanted AS {_newest(ORDERS_SQL, 20)}, {ASSIGN})
SELECT base_url, model_id, version FROM three""",
)
def m8b(spark, sf):
    """Three snapshots: all models, without a third of them (older ones come back), and all again."""
    path = fresh_path(spark, "snapshots")
    every = models(spark, sf).select("base_url", "model_id", "updated")
    for rows in (every, every.where("model_id % 3 <> 0"), every):
        rows.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return V.version_sync(stream, 20, "m8b")


RATES = f"""SELECT date_trunc('minute', ts) AS w, event_type AS url, {first_bound_sql('value / 100', LATENCY_BOUNDS)} AS bucket, count(*) AS n FROM events GROUP BY ALL"""


@query(
    "m9_windowed_rates",
    f"""WITH r AS ({RATES}) SELECT epoch(w)::BIGINT AS window_start, url, CASE WHEN bucket = {INF} THEN 'inf' ELSE bucket::VARCHAR END AS bucket, n,
  round(100.0 * n / sum(n) OVER (PARTITION BY w, url), 6) AS share FROM r
WHERE w + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def m9(spark, sf):
    M.use_rocksdb(spark)
    ev = event_stream(spark, sf).select("ts", F.col("event_type").alias("url"), (F.col("value") / 100).alias("latency"))
    rates = M.windowed_rates(ev, H.first_bound("latency", LATENCY_BOUNDS))
    done = M.run_to_table(rates, "m9", mode="append")
    b = F.when(F.col("bucket") == H.INF, "inf").otherwise(F.col("bucket").cast("string"))
    return M.window_shares(done).select(F.unix_timestamp("window_start").alias("window_start"), "url", b.alias("bucket"), "n", r6("share"))


def _merge_sql(update: bool) -> str:
    both = "'extra=counter,' || {}p_type || '=value,size=enum'".format("") if update else "'extra=counter,' || p_type || '=value'"
    return f"""SELECT p_partkey AS endpoint, array_to_string(list_sort(string_split(CASE WHEN p_size > 20 THEN {both} ELSE p_type || '=scalar,size=enum' END, ',')), ',') AS metrics FROM part"""


def merged(spark, sf, update):
    part = table(spark, sf, "part")
    old = part.select(F.col("p_partkey").alias("endpoint"), F.create_map("p_type", F.lit("scalar"), F.lit("size"), F.lit("enum")).alias("metrics"))
    new = part.where("p_size > 20").select(
        F.col("p_partkey").alias("endpoint"), F.create_map("p_type", F.lit("value"), F.lit("extra"), F.lit("counter")).alias("metrics")
    )
    out = C.merge_metric_config(old, new, update)
    text = F.array_join(F.array_sort(F.transform(F.map_entries("metrics"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return out.select("endpoint", text.alias("metrics"))


@query("m10_merge_metric_config", _merge_sql(True))
def m10(spark, sf):
    return merged(spark, sf, True)


@query("m10b_replace_metric_config", _merge_sql(False))
def m10b(spark, sf):
    return merged(spark, sf, False)


@query(
    "s5_read_stats_stream",
    """SELECT event_type AS url, 'k' AS variable, count(*) AS n, sum(json_extract_string(props, '$.k')::DOUBLE) AS total FROM events WHERE event_type <> 'error' GROUP BY event_type
UNION ALL SELECT event_type, 'list', 2 * count(*), sum(user_id + 1)::DOUBLE FROM events WHERE event_type <> 'error' GROUP BY event_type""",
)
def s5(spark, sf):
    # events of type error carry no url and are skipped; one message is broken
    ev = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("_url"),
        F.get_json_object("props", "$.k").alias("k"),
        F.array(F.lit(1), F.col("user_id")).alias("list"),
    )
    packed = stats.pack_batches(ev, "event_id", 8000, ["_url", "k", "list"])
    path = fresh_path(spark, "messages")
    broken = spark.range(1).select(F.lit('[{"_url": "cut').alias("message"))
    stats.write_messages(packed.select("message").unionByName(broken), "text", {"path": path})
    rows = stats.event_variables(stats.unpack_events(stats.read_stats_stream(spark, "text", {"path": path})))
    totals = rows.groupBy("url", "variable").agg(F.count("*").alias("n"), F.sum(F.col("value").try_cast("double")).alias("total"))
    return M.run_to_table(totals, "s5")
