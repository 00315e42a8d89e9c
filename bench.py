"""Headline queries, timed end to end; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma separated names) choose what runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "t22_feature_table", "x13_clean_text", "t1_text_counts", "t8_semantic_density", "t11_lexicon_scores",
    "t12_textual_entropy", "t17_branching", "t18_rules", "t21_annotate", "j9_unfamiliar_words", "w2_token_bigrams",
    "v1_encode_tokens", "o1_sample_per_label", "o6_split", "a4_distinct_rows", "a12_roc_curve", "a18_latency_histogram",
    "a22_bucket_share_over_time", "j1_lookup_metric_config", "m3_metrics_stream", "m7_route_canary", "m9_windowed_rates",
    "s6_pack_batches", "w3_assign_versions", "v5_scale_feature_groups", "v6_batch_score", "v8_knn_regress",
    "v11_explain_additive", "plan_score_requests",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from inkgauge.session import local_session
    from suite.all import QUERIES

    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
