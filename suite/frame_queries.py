"""Scans, projections, joins, aggregates, sampling, sets (S, P, J, A, O, U, X15-X27, V3-V5)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from inkgauge.fixed import DETAILED_PROMPT, REWRITE_PROMPT, STANDARD_PROMPT
from inkgauge.functions import urls, vectors
from inkgauge.operators import config as C
from inkgauge.operators import evaluation as E
from inkgauge.operators import frame as P
from inkgauge.operators import ordering, routing, sampling, scaling, scorer, versions
from inkgauge.session import fresh_path
from inkgauge.sources import sinks, stats, tables

from .base import ESSAYS_SQL, PREDICTIONS_SQL, big, draw_hex_sql, draw_sql, essays, predictions, query, r6, table
from .textsql import lit

DOCS_NULL = "(SELECT doc_id, nullif(lang, 'fr') AS lang, nullif(source, 'src7') AS source, text FROM documents)"


def docs_null(spark, sf):
    """Documents with some languages and sources missing."""
    return table(spark, sf, "documents").select(
        "doc_id", F.expr("nullif(lang, 'fr')").alias("lang"), F.expr("nullif(source, 'src7')").alias("source"), "text"
    )


# -- sources and sinks ------------------------------------------------------

@query(
    "s1_scan_csv_union",
    "SELECT doc_id, text, source, NULL::VARCHAR AS lang FROM documents UNION ALL SELECT doc_id, text, NULL, lang FROM documents",
)
def s1(spark, sf):
    root = fresh_path(spark, "csv")
    docs = table(spark, sf, "documents")
    opts = dict(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    docs.select("doc_id", "text", "source").write.csv(f"{root}/a", **opts)
    docs.select("lang", "doc_id", "text").write.csv(f"{root}/b", **opts)
    out = tables.scan_csv_union(spark, f"{root}/*/*.csv", ["doc_id", "text", "source", "lang"])
    return P.cast_columns(out, {"doc_id": "bigint"})


@query(
    "s2_scan_labelled",
    f"SELECT doc_id, text, label, source FROM (SELECT doc_id, text, label, nullif(source, 'src7') AS source FROM {ESSAYS_SQL}) WHERE source IS NOT NULL",
)
def s2(spark, sf):
    df = essays(spark, sf).withColumn("source", F.expr("nullif(source, 'src7')"))
    return tables.typed_labelled(df, keep=["doc_id"])


@query("s3_write_dataset_version", f"SELECT doc_id, text, source, label FROM {ESSAYS_SQL}")
def s3(spark, sf):
    root = fresh_path(spark, "datasets")
    version = sinks.write_dataset_version(essays(spark, sf), root, "essays", "labelled essays", ["train"])
    return sinks.read_dataset_version(spark, root, "essays", version).select("doc_id", "text", "source", "label")


@query("s3b_concurrent_versions", f"SELECT doc_id, label, 2 AS versions, 2 AS paths FROM {ESSAYS_SQL}")
def s3b(spark, sf):
    """Two writers at once: both versions are listed, and together they hold all rows."""
    root, rows = fresh_path(spark, "datasets"), essays(spark, sf)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: sinks.write_dataset_version(rows.where(F.col("label") == k), root, "essays"), (0, 1)))
    listed = sinks.read_manifest(spark, root).agg(F.max("version").alias("versions"), F.count_distinct("path").cast("int").alias("paths")).first()
    both = sinks.read_dataset_version(spark, root, "essays", 1).unionByName(sinks.read_dataset_version(spark, root, "essays", 2))
    return both.select("doc_id", "label", F.lit(listed["versions"]).alias("versions"), F.lit(listed["paths"]).alias("paths"))


@query("s4_write_submission", f"SELECT doc_id AS id, score AS generated FROM {PREDICTIONS_SQL}")
def s4(spark, sf):
    path = fresh_path(spark, "submission")
    sinks.write_submission(predictions(spark, sf).select(F.col("doc_id").alias("id"), F.col("score").alias("generated")), path)
    return spark.read.csv(path, header=True, schema="id bigint, generated double")


PACK_COLS = ["event_id", "event_type", "props", "user_id"]


@query(
    "s6_pack_batches",
    f"""WITH j AS (SELECT event_id, octet_length(encode(to_json({{'event_id': event_id, 'event_type': event_type, 'props': props, 'user_id': user_id}})::VARCHAR)) AS len FROM events),
b AS (SELECT greatest(1, ceil(sum(len) / 100000.0)) AS blocks FROM j),
r AS (SELECT event_id, floor({draw_sql('event_id', 'pack')} * blocks)::BIGINT AS block, len + 1 AS len FROM j, b),
c AS (SELECT block, len, floor(coalesce(sum(len) OVER (PARTITION BY block ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  / greatest(3999 - max(len) OVER (PARTITION BY block), 1))::BIGINT AS chunk FROM r)
SELECT block, chunk, count(*) AS n, (sum(len) + 1)::BIGINT AS bytes FROM c GROUP BY ALL""",
)
def s6(spark, sf):
    packed = stats.pack_batches(table(spark, sf, "events"), "event_id", 4000, PACK_COLS, block_bytes=100_000)
    return packed.select("block", "chunk", "n", "bytes")


SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS col, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem"
    for c in SCALED
)


@query("s7_save_load_scaler", STATS)
def s7(spark, sf):
    path = fresh_path(spark, "scaler")
    scaling.save_scaler(scaling.fit_scaler(table(spark, sf, "lineitem"), SCALED), path)
    return scaling.load_scaler(spark, path).select("col", "min", "max", r6("mean"), r6("std"))


@query("a19_fit_minmax", "SELECT min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max, 'n_chars' AS col FROM documents")
def a19(spark, sf):
    return scaling.fit_scaler(table(spark, sf, "documents"), ["n_chars"]).select("col", "min", "max")


@query("a20_fit_standard", STATS.replace("min(", "min(").replace(" AS min,", " AS lo,").replace(" AS max,", " AS hi,"))
def a20(spark, sf):
    out = scaling.fit_scaler(table(spark, sf, "lineitem"), SCALED)
    return out.select("col", F.col("min").alias("lo"), F.col("max").alias("hi"), r6("mean"), r6("std"))


LINE_SQL = """(SELECT CASE WHEN event_type = 'signup' THEN '# HELP ' || event_type WHEN event_type = 'error' THEN event_type || ' broken'
  WHEN event_type = 'view' THEN event_type || '{gpu_uuid="g1",model="m' || user_id || '",version="2"} ' || user_id
  ELSE event_type || '{model="m' || user_id || '",version="1"} ' || user_id END AS value FROM events)"""


@query(
    "s9_scan_metrics_text",
    """SELECT metric, model, version, model || '.v' || version AS series, value FROM (
  SELECT event_type AS metric, 'm' || user_id AS model, CASE WHEN event_type = 'view' THEN '2' ELSE '1' END AS version, user_id::DOUBLE AS value
  FROM events WHERE event_type NOT IN ('signup', 'error'))""",
)
def s9(spark, sf):
    e = F.col("event_type")
    user = F.col("user_id").cast("string")
    line = (
        F.when(e == "signup", F.concat(F.lit("# HELP "), e))
        .when(e == "error", F.concat(e, F.lit(" broken")))
        .when(e == "view", F.concat(e, F.lit('{gpu_uuid="g1",model="m'), user, F.lit('",version="2"} '), user))
        .otherwise(F.concat(e, F.lit('{model="m'), user, F.lit('",version="1"} '), user))
    )
    path = fresh_path(spark, "metrics-text")
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return tables.scan_metrics_text(spark.read.text(path))


@query("s10_read_requests", "SELECT json_extract_string(props, '$.k')::INT AS k, NULL::DOUBLE AS x0, count(*) AS n FROM events GROUP BY ALL")
def s10(spark, sf):
    path = fresh_path(spark, "requests")
    table(spark, sf, "events").select("props").write.text(path, compression="gzip")
    return tables.read_requests(spark, path, "k int, x0 double").groupBy("k", "x0").agg(F.count("*").alias("n"))


# -- projections ------------------------------------------------------------

@query("p1_select_columns", "SELECT doc_id, lang, source FROM documents")
def p1(spark, sf):
    return P.select_columns(table(spark, sf, "documents"), ["doc_id", "lang", "source"])


@query("p2_drop_missing", "SELECT event_id, event_type FROM (SELECT event_id, nullif(event_type, 'view') AS event_type FROM events) WHERE event_type IS NOT NULL")
def p2(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.expr("nullif(event_type, 'view')").alias("event_type"))
    return P.drop_missing(df, ["event_type"])


@query("p3_filter_label", "SELECT doc_id, quality FROM labels WHERE quality = 1")
def p3(spark, sf):
    return P.filter_label(table(spark, sf, "labels", "doc_id", "quality"), 1, "quality")


@query("p4_rename", "SELECT doc_id AS id, quality AS label FROM labels")
def p4(spark, sf):
    return P.rename(table(spark, sf, "labels", "doc_id", "quality"), {"doc_id": "id", "quality": "label"})


@query("p5_with_literal", "SELECT item_id, text, 'benchmark' AS source, 1 AS label FROM benchmark")
def p5(spark, sf):
    return P.with_literal(P.with_literal(table(spark, sf, "benchmark"), "source", "benchmark"), "label", 1)


@query("p6_cast_columns", "SELECT event_id::VARCHAR AS event_id, try_cast(event_type AS INT) AS event_type, try_cast(value AS DOUBLE)::VARCHAR IS NOT NULL AS ok FROM events")
def p6(spark, sf):
    df = P.cast_columns(table(spark, sf, "events", "event_id", "event_type", "value"), {"event_id": "string", "event_type": "int"})
    return df.select("event_id", "event_type", F.col("value").isNotNull().alias("ok"))


@query(
    "p7_build_prompts",
    f"""SELECT doc_id, {lit(STANDARD_PROMPT)} || lang AS standard_prompt, {lit(DETAILED_PROMPT)} || lang AS altered_prompt,
  {lit(REWRITE_PROMPT)} || text AS rewrite_prompt FROM {DOCS_NULL}""",
)
def p7(spark, sf):
    df = docs_null(spark, sf).withColumnRenamed("lang", "prompt")
    return P.build_prompts(df).select("doc_id", "standard_prompt", "altered_prompt", "rewrite_prompt")


@query("p8_append_columns", "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def p8(spark, sf):
    return P.append_columns(table(spark, sf, "documents", "doc_id", "lang"), table(spark, sf, "labels"))


@query("p9_expand_map", "SELECT event_id, json_extract_string(props, '$.k') AS k, '0' AS missing FROM events")
def p9(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return P.expand_map(df, "m", ["k", "missing"], default="0")


@query("p11_interpret_score", f"SELECT doc_id, CASE WHEN score < 0.5 THEN 'human' WHEN score > 0.5 THEN 'LLM' END AS verdict FROM {PREDICTIONS_SQL}")
def p11(spark, sf):
    return predictions(spark, sf).select("doc_id", P.interpret_score("score").alias("verdict"))


@query(
    "p12_features_long",
    """SELECT doc_id, "group", feature, value FROM (
  SELECT doc_id, 'size' AS "group", 'n_chars' AS feature, n_chars::DOUBLE AS value FROM documents
  UNION ALL SELECT doc_id, 'size', 'n_text', length(text)::DOUBLE FROM documents
  UNION ALL SELECT doc_id, 'origin', 'lang_len', length(lang)::DOUBLE FROM documents)""",
)
def p12(spark, sf):
    df = table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.length("text").alias("n_text"), F.length("lang").alias("lang_len")
    )
    groups = spark.createDataFrame([("n_chars", "size"), ("n_text", "size"), ("lang_len", "origin")], "feature string, group string")
    return P.features_long(df, groups, ["n_chars", "n_text", "lang_len"])


@query(
    "p13_select_logged_keys",
    "SELECT event_id, 'k=' || CASE WHEN event_type = 'click' THEN 'over' ELSE json_extract_string(props, '$.k') END || ',out=' || event_type AS logged FROM events",
)
def p13(spark, sf):
    e = F.col("event_type")
    req = F.from_json("props", "map<string,string>")
    res = F.map_filter(
        F.create_map(F.lit("out"), e, F.lit("k"), F.when(e == "click", "over"), F.lit("noise"), F.lit("1")), lambda _k, v: v.isNotNull()
    )
    logged = P.select_logged_keys(req, res, F.array(F.lit("k"), F.lit("out"), F.lit("absent")))
    entries = F.array_sort(F.transform(F.map_entries(logged), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return table(spark, sf, "events").select("event_id", F.array_join(entries, ",").alias("logged"))


def endpoint_rows(spark, sf):
    """Endpoint and monitoring configuration rows drawn from ``part``."""
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("serving_url"),
        F.when(size % 2 == 0, "triton").otherwise("sklearn").alias("engine_type"),
        F.when(size % 3 != 0, "float32").alias("input_type"),
        F.lit("128").alias("input_size"),
        F.when(size % 5 != 0, F.col("p_name")).otherwise("").alias("input_name"),
        F.lit("float32").alias("output_type"),
        F.lit("2").alias("output_size"),
        F.col("p_name").alias("output_name"),
        F.when(size % 7 != 0, F.col("p_brand")).alias("monitor_project"),
        F.lit(None).cast("string").alias("monitor_name"),
        F.when(size % 2 == 0, F.array(F.col("p_type"))).otherwise(F.array().cast("array<string>")).alias("monitor_tags"),
        F.when(size % 4 == 0, F.col("p_brand")).alias("load_endpoint_prefix"),
        F.when(size % 6 == 0, F.array(F.col("p_name"))).otherwise(F.array().cast("array<string>")).alias("load_endpoints"),
        F.when(size % 9 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0))).alias("weights"),
        F.when(size % 10 == 0, "sum").otherwise("enum").alias("type"),
    )


@query(
    "p14_validate_configs",
    """SELECT p_partkey AS key, 'missing input_type' AS reason FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0
UNION ALL SELECT p_partkey, 'missing input_name' FROM part WHERE p_size % 2 = 0 AND p_size % 5 = 0
UNION ALL SELECT p_partkey, 'nothing to monitor' FROM part WHERE p_size % 7 = 0 AND p_size % 2 <> 0
UNION ALL SELECT p_partkey, 'prefix and list both set' FROM part WHERE p_size % 4 = 0 AND p_size % 6 = 0
UNION ALL SELECT p_partkey, 'weights do not match targets' FROM part WHERE p_size % 4 <> 0 AND p_size % 6 = 0 AND p_size % 9 = 0
UNION ALL SELECT p_partkey, 'unknown metric type' FROM part WHERE p_size % 10 = 0""",
)
def p14(spark, sf):
    df = endpoint_rows(spark, sf)
    checks = [C.validate_endpoints, C.validate_monitoring, C.validate_canary, C.validate_metrics]
    return P.union_by_name(*[c(df, "serving_url").withColumnRenamed("serving_url", "key") for c in checks])


# -- joins with configuration -----------------------------------------------

STATS_ROWS = """(SELECT event_type AS url, '_latency' AS variable, (value / 100)::VARCHAR AS value FROM events
  UNION ALL SELECT event_type, '_count', '1' FROM events
  UNION ALL SELECT event_type, 'k', json_extract_string(props, '$.k') FROM events
  UNION ALL SELECT event_type, 'user', user_id::VARCHAR FROM events)"""


def stats_rows(df):
    """``url, variable, value`` rows of events; works on streams as well."""
    variables = F.create_map(
        F.lit("_latency"), (F.col("value") / 100).cast("string"),
        F.lit("_count"), F.lit("1"),
        F.lit("k"), F.get_json_object("props", "$.k"),
        F.lit("user"), F.col("user_id").cast("string"),
    )
    return df.select(F.col("event_type").alias("url"), "ts", "event_id", F.explode(variables).alias("variable", "value"))


METRIC_CFG = [
    ("click", "k", "scalar", ["10", "50", "90"]),
    ("view", "k", "enum", ["1", "2", "3"]),
    ("error", "user", "counter", None),
    ("signup", "k", "value", None),
    ("nowhere", "k", "scalar", ["1"]),
]


def metric_cfg(spark):
    return spark.createDataFrame(METRIC_CFG, "url string, variable string, type string, buckets array<string>")


CFG_SQL = "(VALUES ('click', 'k', 'scalar'), ('view', 'k', 'enum'), ('error', 'user', 'counter'), ('signup', 'k', 'value'), ('nowhere', 'k', 'scalar')) c(url, variable, type)"


@query(
    "j1_lookup_metric_config",
    f"""SELECT s.url, s.variable, CASE s.variable WHEN '_latency' THEN 'scalar' WHEN '_count' THEN 'counter' ELSE c.type END AS type, count(*) AS n
FROM {STATS_ROWS} s LEFT JOIN {CFG_SQL} ON c.url = s.url AND c.variable = s.variable
WHERE s.variable IN ('_latency', '_count') OR c.type IS NOT NULL GROUP BY ALL""",
)
def j1(spark, sf):
    rows = C.lookup_metric_config(stats_rows(table(spark, sf, "events")), metric_cfg(spark))
    return rows.groupBy("url", "variable", "type").agg(F.count("*").alias("n"))


PREFIX_CFG = [("Brand#2/*", 1), ("Brand#1*", 2), ("Brand#17/28", 3), ("Brand#17/*", 4), ("Brand#2/7", 5)]


@query(
    "j2_match_prefix_config",
    """WITH cfg(name, ord) AS (VALUES ('Brand#2/*', 1), ('Brand#1*', 2), ('Brand#17/28', 3), ('Brand#17/*', 4), ('Brand#2/7', 5)),
u AS (SELECT DISTINCT p_brand || '/' || p_size AS url FROM part),
h AS (SELECT url, name, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN name LIKE '%*' THEN 1 ELSE 0 END, ord) AS rn
  FROM u JOIN cfg ON url = name OR (name LIKE '%*' AND starts_with(url, left(name, length(name) - 1))))
SELECT url, name FROM h WHERE rn = 1""",
)
def j2(spark, sf):
    return C.match_prefix_config(part_urls(spark, sf), spark.createDataFrame(PREFIX_CFG, "name string, ord int"))


def part_urls(spark, sf):
    return table(spark, sf, "part").select(urls.normalize_url("p_brand", "p_size").alias("url"))


STATIC = [("click", "m1"), ("view", "m2")]
MONITORED = [("click", "m9"), ("error", "m3")]
STATIC_SQL = "(VALUES ('click', 'm1'), ('view', 'm2')) s(url, model_id)"
MONITORED_SQL = "(VALUES ('click', 'm9'), ('error', 'm3')) m(url, model_id)"


def endpoint_tables(spark):
    return (spark.createDataFrame(STATIC, "url string, model_id string"), spark.createDataFrame(MONITORED, "url string, model_id string"))


@query(
    "j3_resolve_endpoint",
    f"""SELECT event_id, e.event_type AS url, coalesce(s.model_id, m.model_id) AS model_id,
  CASE WHEN s.model_id IS NOT NULL THEN 'static' WHEN m.model_id IS NOT NULL THEN 'monitored' END AS found_in
FROM events e LEFT JOIN {STATIC_SQL} ON s.url = e.event_type LEFT JOIN {MONITORED_SQL} ON m.url = e.event_type""",
)
def j3(spark, sf):
    reqs = table(spark, sf, "events").select("event_id", F.col("event_type").alias("url"))
    return C.resolve_endpoint(reqs, *endpoint_tables(spark))


@query("j3b_unresolved", "SELECT event_id, event_type AS url FROM events WHERE event_type NOT IN ('click', 'view', 'error')")
def j3b(spark, sf):
    reqs = table(spark, sf, "events").select("event_id", F.col("event_type").alias("url"))
    return C.unresolved(reqs, *endpoint_tables(spark)).select("event_id", "url")


CANARY_SQL = """live AS (SELECT DISTINCT p_brand || '/' || p_size AS url FROM part),
canary AS (SELECT DISTINCT p_brand AS endpoint, p_size AS ord, p_brand || '/' || (p_size + 10) AS target, p_size::DOUBLE AS weight FROM part),
kept AS (SELECT endpoint, ord, target, weight / sum(weight) OVER (PARTITION BY endpoint) AS weight FROM canary WHERE target IN (SELECT url FROM live))"""


def canary_rows(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("endpoint"),
        F.col("p_size").alias("ord"),
        urls.normalize_url("p_brand", F.col("p_size") + 10).alias("target"),
        F.col("p_size").cast("double").alias("weight"),
    ).distinct()


@query("j4_existing_targets", f"WITH {CANARY_SQL} SELECT endpoint, ord, target, round(weight, 6) AS weight FROM kept")
def j4(spark, sf):
    return routing.existing_targets(canary_rows(spark, sf), part_urls(spark, sf)).select("endpoint", "ord", "target", r6("weight"))


@query(
    "w5_cumulative_weights",
    f"WITH {CANARY_SQL}, c AS (SELECT *, sum(weight) OVER (PARTITION BY endpoint ORDER BY ord ROWS UNBOUNDED PRECEDING) AS hi FROM kept) SELECT endpoint, ord, round(hi - weight, 6) AS lo, round(hi, 6) AS hi FROM c",
)
def w5(spark, sf):
    t = routing.existing_targets(canary_rows(spark, sf), part_urls(spark, sf))
    return routing.cumulative_weights(t).select("endpoint", "ord", r6("lo"), r6("hi"))


@query(
    "w4_rank_prefix_targets",
    """WITH u AS (SELECT DISTINCT p_brand || '/' || p_size AS url, p_brand, p_size FROM part),
canary(endpoint, prefix, weights) AS (VALUES ('live1', 'Brand#1/', [5.0::DOUBLE, 3.0, 2.0]), ('live2', 'Brand#2', [1.0, 1.0])),
r AS (SELECT endpoint, url, weights, row_number() OVER (PARTITION BY endpoint ORDER BY p_brand || '/' || lpad(p_size::VARCHAR, 9, '0') DESC) AS ord
  FROM u JOIN canary ON starts_with(url, prefix)),
k AS (SELECT endpoint, ord, url AS target, weights[ord] AS weight FROM r WHERE ord <= len(weights))
SELECT endpoint, ord::INT AS ord, target, round(weight / sum(weight) OVER (PARTITION BY endpoint), 6) AS weight FROM k""",
)
def w4(spark, sf):
    cfg = spark.createDataFrame(
        [("live1", "Brand#1/", [5.0, 3.0, 2.0]), ("live2", "Brand#2", [1.0, 1.0])], "endpoint string, prefix string, weights array<double>"
    )
    return routing.rank_prefix_targets(cfg, part_urls(spark, sf)).select("endpoint", "ord", "target", r6("weight"))


ORDERS_SQL = "(SELECT o_orderpriority AS base_url, o_orderkey AS model_id, o_orderdate AS updated, o_orderstatus AS status FROM orders)"
CURRENT_SQL = "(SELECT o_orderpriority AS base_url, o_orderkey AS model_id, o_orderkey + 1 AS version FROM orders WHERE o_orderstatus = 'F')"


def models(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("base_url"), F.col("o_orderkey").alias("model_id"),
        F.col("o_orderdate").alias("updated"), F.col("o_orderstatus").alias("status"),
    )


def current_versions(spark, sf):
    return models(spark, sf).where("status = 'F'").select("base_url", "model_id", (F.col("model_id") + 1).alias("version"))


@query(
    "j5_stale_versions",
    f"SELECT base_url, version, model_id FROM {CURRENT_SQL} c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = c.base_url AND o.o_custkey = c.version)",
)
def j5(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("base_url"), F.col("o_custkey").alias("version")).distinct()
    return versions.stale_versions(current_versions(spark, sf), wanted).select("base_url", "version", "model_id")


@query("j6_known_versions", f"SELECT m.base_url, m.model_id, c.version FROM {ORDERS_SQL} m LEFT JOIN {CURRENT_SQL} c USING (base_url, model_id)")
def j6(spark, sf):
    return versions.known_versions(models(spark, sf).select("base_url", "model_id"), current_versions(spark, sf))


ASSIGN = """top AS (SELECT base_url, max(version) AS top FROM cur GROUP BY base_url),
fresh AS (SELECT m.base_url, m.model_id, row_number() OVER (PARTITION BY m.base_url ORDER BY m.updated, m.model_id) AS n
  FROM wanted m LEFT JOIN cur c USING (base_url, model_id) WHERE c.version IS NULL)
SELECT base_url, model_id, version FROM wanted JOIN cur USING (base_url, model_id)
UNION ALL SELECT f.base_url, f.model_id, coalesce(t.top, 0) + n FROM fresh f LEFT JOIN top t USING (base_url)"""


@query("w3_assign_versions", f"WITH cur AS {CURRENT_SQL}, wanted AS {ORDERS_SQL}, {ASSIGN}")
def w3(spark, sf):
    return versions.assign_versions(models(spark, sf), current_versions(spark, sf))


@query(
    "w3b_assign_latest_versions",
    f"""WITH cur AS {CURRENT_SQL}, wanted AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY base_url ORDER BY updated DESC, model_id DESC) AS rn
  FROM {ORDERS_SQL}) WHERE rn <= 40), {ASSIGN}""",
)
def w3b(spark, sf):
    return versions.assign_versions(models(spark, sf), current_versions(spark, sf), 40)


@query(
    "j7_ensemble_scores",
    f"SELECT d.doc_id, round(0.5 * (n_chars / 10000.0::DOUBLE) + 0.5 * quality, 6) AS score FROM documents d JOIN labels l USING (doc_id)",
)
def j7(spark, sf):
    a, b = score_tables(spark, sf)
    return scorer.ensemble_scores(a, b, "doc_id").select("doc_id", r6("score"))


def score_tables(spark, sf):
    a = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / F.lit(10000.0)).alias("score"))
    b = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    return a, b


@query("j7b_ensemble_errors", "SELECT doc_id, 'b' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j7b(spark, sf):
    return scorer.ensemble_errors(*score_tables(spark, sf), "doc_id")


# -- aggregates -------------------------------------------------------------

@query(
    "a1_first_per_group",
    f"""SELECT source, arg_min(lang, doc_id) FILTER (WHERE lang IS NOT NULL) AS lang, arg_min(text, doc_id) FILTER (WHERE text IS NOT NULL) AS text
FROM {DOCS_NULL} WHERE source IS NOT NULL GROUP BY source""",
)
def a1(spark, sf):
    return P.first_per_group(docs_null(spark, sf), "source", "doc_id", ["lang", "text"])


@query(
    "a2_counts_by_source_label",
    f"SELECT source, count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1 FROM {ESSAYS_SQL} GROUP BY source",
)
def a2(spark, sf):
    return P.counts_by_source_label(essays(spark, sf))


@query("a3_label_distribution", "SELECT quality, count(*) AS n FROM labels GROUP BY quality ORDER BY quality")
def a3(spark, sf):
    return P.label_distribution(table(spark, sf, "labels"), "quality")


@query("a4_distinct_rows", "SELECT DISTINCT text, lang FROM documents")
def a4(spark, sf):
    return P.distinct_rows(table(spark, sf, "documents"), ["text", "lang"])


@query("a5_mean_std_max", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS max FROM events GROUP BY event_type")
def a5(spark, sf):
    return P.mean_std_max(table(spark, sf, "events"), "event_type", "value").select("event_type", r6("mean"), r6("std"), "max")


@query(
    "a6_mode_first",
    """WITH c AS (SELECT event_type, user_id, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL)
SELECT event_type, user_id AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, seen) AS rn FROM c) WHERE rn = 1""",
)
def a6(spark, sf):
    return P.mode_first(table(spark, sf, "events"), "event_type", "user_id", "event_id")


@query("a7_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS n_user_id, count(DISTINCT props) AS n_props FROM events GROUP BY event_type")
def a7(spark, sf):
    return P.count_distinct(table(spark, sf, "events"), "event_type", ["user_id", "props"])


@query(
    "a8_confusion_matrix",
    f"SELECT l.label, p.prediction, count(x.doc_id) AS n FROM (VALUES (0), (1)) l(label), (VALUES (0), (1)) p(prediction) LEFT JOIN {PREDICTIONS_SQL} x ON x.label = l.label AND x.prediction = p.prediction GROUP BY ALL",
)
def a8(spark, sf):
    return E.confusion_matrix(predictions(spark, sf))


CONF = f"c AS (SELECT count(*) FILTER (WHERE label=1 AND prediction=1) AS tp, count(*) FILTER (WHERE label=0 AND prediction=1) AS fp, count(*) FILTER (WHERE label=1 AND prediction=0) AS fn, count(*) FILTER (WHERE label=0 AND prediction=0) AS tn FROM {PREDICTIONS_SQL})"


@query(
    "a9_binary_metrics",
    f"""WITH {CONF} SELECT round((tp+tn)::DOUBLE/(tp+fp+fn+tn), 6) AS accuracy, round(coalesce(tp::DOUBLE/nullif(tp+fp,0), 1.0), 6) AS precision,
  round(coalesce(tp::DOUBLE/nullif(tp+fn,0), 0.0), 6) AS recall, round(coalesce(2.0::DOUBLE*tp/nullif(2*tp+fp+fn,0), 1.0), 6) AS f1,
  round((coalesce(tp::DOUBLE/nullif(tp+fn,0),0.0) + coalesce(tn::DOUBLE/nullif(tn+fp,0),0.0))/2, 6) AS auc FROM c""",
)
def a9(spark, sf):
    return E.binary_metrics(predictions(spark, sf)).select(*[r6(c) for c in ("accuracy", "precision", "recall", "f1", "auc")])


@query(
    "a10_classification_report",
    f"""WITH {CONF}, per AS (
  SELECT '1' AS class, coalesce(tp::DOUBLE/nullif(tp+fp,0),0.0) AS precision, coalesce(tp::DOUBLE/nullif(tp+fn,0),0.0) AS recall, coalesce(2.0::DOUBLE*tp/nullif(2*tp+fp+fn,0),0.0) AS f1, tp+fn AS support FROM c
  UNION ALL SELECT '0', coalesce(tn::DOUBLE/nullif(tn+fn,0),0.0), coalesce(tn::DOUBLE/nullif(tn+fp,0),0.0), coalesce(2.0::DOUBLE*tn/nullif(2*tn+fp+fn,0),0.0), tn+fp FROM c),
a AS (SELECT * FROM per UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per
  UNION ALL SELECT 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1*support)/sum(support), sum(support) FROM per)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM a""",
)
def a10(spark, sf):
    return E.classification_report(predictions(spark, sf)).select("class", r6("precision"), r6("recall"), r6("f1"), "support")


@query("a11_accuracy", f"SELECT sum((label = prediction)::INT)::BIGINT AS correct, count(*) AS total, round(avg((label = prediction)::INT), 6) AS accuracy FROM {PREDICTIONS_SQL}")
def a11(spark, sf):
    return E.accuracy(predictions(spark, sf)).select("correct", "total", r6("accuracy"))


@query("a11b_misclassified_rows", f"SELECT doc_id, label, prediction FROM {PREDICTIONS_SQL} WHERE label <> prediction")
def a11b(spark, sf):
    return E.misclassified_rows(predictions(spark, sf)).select("doc_id", "label", "prediction")


CURVE = f"""s AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM {PREDICTIONS_SQL} GROUP BY score),
r AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s
  WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query("w6_running_tp_fp", f"WITH {CURVE} SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp FROM r")
def w6(spark, sf):
    return E.threshold_counts(predictions(spark, sf)).select("score", big("tp"), big("fp"))


@query("a12_roc_curve", f"WITH {CURVE} SELECT score AS threshold, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr FROM r")
def a12(spark, sf):
    return E.roc_curve(predictions(spark, sf)).select("threshold", r6("tpr"), r6("fpr"))


@query("a12b_roc_auc", f"WITH {CURVE} SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS auc FROM r")
def a12b(spark, sf):
    return E.roc_auc(predictions(spark, sf)).select(r6("auc"))


@query("a13_pr_curve", f"WITH {CURVE} SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM r")
def a13(spark, sf):
    return E.pr_curve(predictions(spark, sf)).select("threshold", r6("precision"), r6("recall"))


@query("a13b_average_precision", f"WITH {CURVE} SELECT round(sum(pos * (tp / (tp + fp))) / sum(pos), 6) AS average_precision FROM r")
def a13b(spark, sf):
    return E.average_precision(predictions(spark, sf)).select(r6("average_precision"))


@query("a21_profile", f"SELECT count(*) AS n_rows, count(doc_id) AS non_null_doc_id, count(lang) AS non_null_lang, count(source) AS non_null_source, count(text) AS non_null_text FROM {DOCS_NULL}")
def a21(spark, sf):
    return P.profile(docs_null(spark, sf))


# -- sampling and order -----------------------------------------------------

H42 = draw_hex_sql("doc_id", 42)


@query("o1_sample_per_label", f"SELECT doc_id, label, source FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H42}, doc_id) AS rn FROM {ESSAYS_SQL}) WHERE rn <= 50")
def o1(spark, sf):
    return sampling.sample_per_label(essays(spark, sf), 50, 42).select("doc_id", "label", "source")


@query(
    "o2_sample_per_label_replace",
    f"""WITH e AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {H42}, doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM {ESSAYS_SQL}),
d AS (SELECT DISTINCT label, n, unnest(range(1, 501)) AS draw_no FROM e),
a AS (SELECT label, draw_no, floor({draw_sql("(label || '/' || draw_no)", 42)} * n)::BIGINT + 1 AS rn FROM d)
SELECT e.doc_id, a.label, a.draw_no FROM a JOIN e USING (label, rn)""",
)
def o2(spark, sf):
    return sampling.sample_per_label_replace(essays(spark, sf), 500, 42).select("doc_id", "label", big("draw_no"))


@query("o3_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {H42}, doc_id) AS position FROM documents")
def o3(spark, sf):
    return sampling.permutation(table(spark, sf, "documents", "doc_id"), 42)


@query("o4_head", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 5")
def o4(spark, sf):
    return sampling.head(table(spark, sf, "documents", "doc_id", "lang"), 5, ["doc_id"])


@query("o5_sample_rows", f"SELECT doc_id, lang FROM documents ORDER BY {H42}, doc_id LIMIT 100")
def o5(spark, sf):
    return sampling.sample_rows(table(spark, sf, "documents", "doc_id", "lang"), 100, 42)


@query(
    "o6_split",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {H42}, doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= floor(0.7 * n + 0.5) THEN 'train' WHEN rn <= floor(0.85 * n + 0.5) THEN 'val' ELSE 'test' END AS part FROM r""",
)
def o6(spark, sf):
    return sampling.split(table(spark, sf, "documents", "doc_id"), [0.7, 0.15, 0.15], 42, names=["train", "val", "test"])


@query("o7_sort_by_key", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY source")
def o7(spark, sf):
    return P.sort_by_key(table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")), "source")


@query(
    "o7b_distributed_rank",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rank FROM orders",
)
def o7b(spark, sf):
    df = table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderdate")
    return ordering.ranked(df, ["o_orderdate", "o_orderkey"], ["o_orderpriority"]).select("o_orderkey", big("rank"))


@query(
    "o8_best_trial",
    "SELECT trial, round(auc, 6) AS auc FROM (SELECT s_nationkey AS trial, avg(s_acctbal) AS auc FROM supplier GROUP BY s_nationkey) ORDER BY auc DESC, trial LIMIT 1",
)
def o8(spark, sf):
    trials = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("trial")).agg(F.avg("s_acctbal").alias("auc"))
    return P.best_trial(trials).select("trial", r6("auc"))


@query(
    "o9_natural_version_sort",
    "SELECT url, row_number() OVER (ORDER BY p_brand || '/' || lpad(p_size::VARCHAR, 9, '0') DESC) AS at FROM (SELECT DISTINCT p_brand, p_size, p_brand || '/' || p_size AS url FROM part)",
)
def o9(spark, sf):
    keyed = part_urls(spark, sf).distinct().withColumn("k", P.version_sort_key(F.col("url")))
    total = ordering.ranked(keyed, ["k"], out="asc")
    n = F.lit(keyed.count())
    return P.natural_version_sort(total).select("url", (n - F.col("asc") + 1).alias("at"))


# -- sets -------------------------------------------------------------------

@query("u1_union_by_name", "SELECT doc_id, text, source, NULL::BIGINT AS item_id FROM documents UNION ALL SELECT NULL, text, 'benchmark', item_id FROM benchmark")
def u1(spark, sf):
    bench = table(spark, sf, "benchmark").withColumn("source", F.lit("benchmark"))
    return P.union_by_name(table(spark, sf, "documents", "doc_id", "text", "source"), bench)


@query("u2_intersect_keys", "SELECT event_id, CASE WHEN json_exists(props, '$.k') THEN 'k' ELSE '' END AS keys FROM events")
def u2(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.array_join(P.intersect_keys(m, F.array(F.lit("k"), F.lit("z"))), ",").alias("keys"))


@query("u3_except_keys", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u3(spark, sf):
    return P.except_keys(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(
    "u4_config_changes",
    """WITH o AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_size <= 40),
n AS (SELECT p_partkey, CASE WHEN p_size = 20 THEN 'Brand#0' ELSE p_brand END AS p_brand, p_size FROM part WHERE p_size >= 10)
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n USING (p_partkey) WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL OR o.p_brand <> n.p_brand""",
)
def u4(spark, sf):
    part = table(spark, sf, "part", "p_partkey", "p_brand", "p_size")
    new = part.where("p_size >= 10").withColumn("p_brand", F.when(F.col("p_size") == 20, "Brand#0").otherwise(F.col("p_brand")))
    return C.config_changes(part.where("p_size <= 40"), new, "p_partkey")


# -- scalar functions -------------------------------------------------------

@query("x15_normalize_url", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || '/' || p_size ELSE p_brand END AS url FROM part")
def x15(spark, sf):
    version = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", urls.normalize_url(F.concat("p_brand", F.lit("//")), version).alias("url"))


@query("x16_metric_name", "SELECT p_partkey, replace(replace(p_brand, '#', '_') || ':' || p_name || '(x)', ' ', '_') AS name FROM part")
def x16(spark, sf):
    return table(spark, sf, "part").select("p_partkey", urls.metric_name("p_brand", F.concat("p_name", F.lit("(x)"))).alias("name"))


@query(
    "x17_parse_bucket_spec",
    """SELECT p_partkey, 'x' AS name, CASE WHEN p_size % 2 = 0 THEN 3 ELSE greatest(ceil(p_size / 4.0), 0) END::BIGINT AS n,
  CASE WHEN p_size % 2 = 0 THEN p_size ELSE (ceil(p_size / 4.0) - 1) * 4 END::DOUBLE AS last FROM part""",
)
def x17(spark, sf):
    size = F.col("p_size").cast("string")
    spec = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("x=0, 1,"), size)).otherwise(F.concat(F.lit("x=0/"), size, F.lit("/4")))
    parsed = urls.parse_bucket_spec(spec)
    return table(spark, sf, "part").select(
        "p_partkey", parsed["name"].alias("name"), big(F.size(parsed["buckets"]), "n"),
        F.try_element_at(parsed["buckets"], F.lit(-1)).alias("last"),
    )


@query("x18_round4", "SELECT event_id, round(value / 700, 4) AS latency FROM events")
def x18(spark, sf):
    return table(spark, sf, "events").select("event_id", urls.round4(F.col("value") / 700).alias("latency"))


@query(
    "x19_json_encode_decode",
    "SELECT event_id, to_json({'event_id': event_id, 'event_type': event_type})::VARCHAR AS body, json_extract_string(props, '$.k')::INT AS k FROM events",
)
def x19(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", urls.json_encode("event_id", "event_type").alias("body"), urls.json_decode("props", "k int")["k"].alias("k")
    )


@query(
    "x20_config_fingerprint",
    "SELECT p_partkey, sha256(to_json({'p_brand': p_brand, 'p_name': p_name, 'p_size': p_size, 'p_type': p_type})::VARCHAR) AS fingerprint FROM part",
)
def x20(spark, sf):
    return table(spark, sf, "part").select("p_partkey", urls.config_fingerprint(["p_type", "p_size", "p_name", "p_brand"]).alias("fingerprint"))


LOGITS = "embedding[1:2]::DOUBLE[]"


def soft(e: str) -> str:
    return f"list_transform({e}, lambda v: exp(v - list_max({e})) / list_sum(list_transform({e}, lambda u: exp(u - list_max({e})))))"


@query("x22_softmax", f"SELECT vec_id, round(s[1], 6) AS s0, round(s[64], 6) AS s63, round(list_sum(s), 6) AS total FROM (SELECT vec_id, {soft('e')} AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")
def x22(spark, sf):
    s = vectors.softmax("embedding")
    return table(spark, sf, "embeddings").select("vec_id", s.alias("s")).select(
        "vec_id", r6(F.get("s", F.lit(0)), "s0"), r6(F.get("s", F.lit(63)), "s63"), r6(F.aggregate("s", F.lit(0.0), lambda a, b: a + b), "total")
    )


@query("x23_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings")
def x23(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", vectors.argmax("embedding").alias("best"))


@query("x24_positive_score", f"SELECT vec_id, round(list_element({soft('p')}, 2), 6) AS probability, (e[2] > e[1])::INT AS predicted_label FROM (SELECT vec_id, e, {soft('e')} AS p FROM (SELECT vec_id, {LOGITS} AS e FROM embeddings))")
def x24(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("logits"))
    return scorer.score_logits(df, "logits").select("vec_id", r6("probability"), "predicted_label")


@query(
    "x25_cosine",
    "SELECT vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS similarity FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings)",
)
def x25(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6(vectors.cosine(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), "similarity"))


@query(
    "x26_one_hot_scale",
    "SELECT vec_id, array_to_string(list_transform(range(8), lambda i: (i = label)::INT), '') AS hot, round(embedding[1]::DOUBLE / 255, 6) AS scaled, round((embedding[1]::DOUBLE - 0.1307) / 0.3081, 6) AS standard FROM embeddings",
)
def x26(spark, sf):
    hot = F.array_join(F.transform(vectors.one_hot("label", 8), lambda v: v.cast("int").cast("string")), "")
    return table(spark, sf, "embeddings").select(
        "vec_id", hot.alias("hot"), r6(F.get(vectors.scale_255("embedding"), F.lit(0)), "scaled"),
        r6(F.get(vectors.standardize_const("embedding"), F.lit(0)), "standard"),
    )


@query("x27_math", "SELECT p_partkey, round(log2(p_retailprice), 6) AS l2, round(sqrt(p_retailprice), 6) AS sq, round(pow(p_size, 2), 6) AS p2, round(ln(p_retailprice), 6) AS ln FROM part")
def x27(spark, sf):
    p = F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", r6(F.log2(p), "l2"), r6(F.sqrt(p), "sq"), r6(F.pow("p_size", F.lit(2)), "p2"), r6(F.ln(p), "ln"))


# -- scaling ----------------------------------------------------------------

def _mm(c):
    return f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}_scaled"


@query(
    "v3_minmax_transform",
    f"SELECT l_orderkey, l_linenumber, {_mm('l_quantity')}, {_mm('l_tax')}, 0.0::DOUBLE AS one_scaled FROM lineitem",
)
def v3(spark, sf):
    df = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax").withColumn("one", F.lit(1.0))
    cols = ["l_quantity", "l_tax", "one"]
    out = scaling.minmax_transform(df, scaling.fit_scaler(df, cols), cols)
    return out.select("l_orderkey", "l_linenumber", *[r6(f"{c}_scaled") for c in cols])


@query(
    "v4_standard_transform",
    "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal_scaled, 0.0::DOUBLE AS one_scaled FROM customer",
)
def v4(spark, sf):
    df = table(spark, sf, "customer", "c_custkey", "c_acctbal").withColumn("one", F.lit(1.0))
    cols = ["c_acctbal", "one"]
    out = scaling.standard_transform(df, scaling.fit_scaler(df, cols), cols)
    return out.select("c_custkey", *[r6(f"{c}_scaled") for c in cols])


@query("v5_scale_feature_groups", f"SELECT l_orderkey, l_linenumber, {', '.join(_mm(c) for c in SCALED)} FROM lineitem")
def v5(spark, sf):
    df = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", *SCALED)
    out, _ = scaling.scale_feature_groups(df, {"size": SCALED[:2], "rates": SCALED[2:]})
    return out.select("l_orderkey", "l_linenumber", *[r6(f"{c}_scaled") for c in SCALED])


@query("p10_feature_projection", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
def p10(spark, sf):
    from inkgauge.plans.feature_table import feature_projection

    return feature_projection(table(spark, sf, "lineitem"), ["l_orderkey", "l_quantity", "l_tax", "l_quantity"])
