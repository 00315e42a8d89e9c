"""Run registered queries next to their SQL in DuckDB and compare the values.

    python -m suite.check [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(v):
    """A value as plain Python, so that both engines compare alike."""
    if isinstance(v, decimal.Decimal):
        return float(v) if v % 1 else int(v)
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, bool):
        return v
    if isinstance(v, float) and v == 0:
        return "-0.0" if math.copysign(1, v) < 0 else 0.0
    return v


def close(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(df, con, sql: str | None):
    """('ok' | 'near' | 'rows' | 'FAIL', detail)"""
    cols = sorted(df.columns)
    got = [[plain(v) for v in r] for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if sql is None:
        return "rows", f"{len(got)} rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return "FAIL", f"columns differ: only spark {set(cols) - set(names)}, only sql {set(names) - set(cols)}"
    at = [names.index(c) for c in cols]
    want = [[plain(r[i]) for i in at] for r in cur.fetchall()]
    if len(got) != len(want):
        return "FAIL", f"{len(got)} rows, sql has {len(want)}"
    got.sort(key=repr)
    want.sort(key=repr)
    if got == want:
        return "ok", f"{len(got)} rows"
    bad = [(g, w) for g, w in zip(got, want) if not all(close(a, b) for a, b in zip(g, w))]
    if not bad:
        diff = sum(g != w for g, w in zip(got, want))
        return "near", f"{diff} of {len(got)} rows differ in the last digits"
    g, w = bad[0]
    cells = [(c, a, b) for c, a, b in zip(cols, g, w) if not close(a, b)]
    return "FAIL", f"{len(bad)} rows differ; first {str(cells)[:600]} in {str(g)[:200]}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from inkgauge.session import local_session
    from suite.all import ORACLES, QUERIES

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.ui.explainMode", "simple")
    con = connect(args.sf)
    names = [n for n in QUERIES if not args.names or any(n.startswith(p) for p in args.names)]
    failed = 0
    for n in names:
        t = time.time()
        try:
            state, detail = compare(QUERIES[n](spark, args.sf), con, ORACLES.get(n))
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            state, detail = "FAIL", f"{type(e).__name__}: {str(e)[:900]}"
        failed += state == "FAIL"
        print(f"{state:5} {n:34} {time.time() - t:6.1f}s  {detail}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
