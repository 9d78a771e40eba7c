"""Run registered queries against their SQL oracles and report differences.

    python tools/compare.py [--sf 0.01] [--only prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from dealscope.plans import load_all  # noqa: E402
from dealscope.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
NESTED_LOOPS = ("CartesianProduct", "BroadcastNestedLoopJoin")
# joins of one-row fingerprints whose constant key the optimizer folds away
SINGLE_ROW_JOINS = ("u6_registry_upsert",)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, q, sf_dir):
    started = time.time()
    df = q.plan(spark, sf_dir)
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    spark_s = time.time() - started
    plan = df._jdf.queryExecution().executedPlan().toString()
    if q.name not in SINGLE_ROW_JOINS and any(join in plan for join in NESTED_LOOPS):
        return ("PLAN", len(got), spark_s, 0.0, "nested-loop or cross join")
    if q.sql is None:
        return ("ROWS", len(got), spark_s, 0.0, "")
    started = time.time()
    cur = con.execute(q.sql)
    want = cur.fetchall()
    want_cols, want = normal([d[0] for d in cur.description], want)
    sql_s = time.time() - started
    if got_cols != want_cols:
        return ("COLS", len(got), spark_s, sql_s, f"{got_cols} != {want_cols}")
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return ("COUNT", len(got), spark_s, sql_s, f"{len(got)} != {len(want)} {str(extra)[:900]}")
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return ("VALUE", len(got), spark_s, sql_s, f"{got_cols} {len(bad)} rows, first {str(bad[0])[:900]}")
    return ("ok" if got else "EMPTY", len(got), spark_s, sql_s, "")


def main():
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("--only", nargs="*", default=[])
    args.add_argument("--skip", nargs="*", default=[])
    args.add_argument("--conf", nargs="*", default=[], help="Spark settings, name=value")
    opt = args.parse_args()
    sf_dir = f"/root/testdata/sf{opt.sf}"
    spark, con = local_session(), connect(sf_dir)
    for setting in opt.conf:
        spark.conf.set(*setting.split("=", 1))
    failed = 0
    for name, q in load_all().items():
        if opt.only and not any(name.startswith(p) for p in opt.only):
            continue
        if any(name.startswith(p) for p in opt.skip):
            continue
        try:
            status, rows, a, b, note = compare(spark, con, q, sf_dir)
        except Exception as exc:  # report and go on with the next query
            status, rows, a, b, note = "ERROR", 0, 0.0, 0.0, f"{type(exc).__name__}: {str(exc)[:1200]}"
        failed += status not in ("ok", "ROWS")
        print(f"{status:6} {name:38} rows={rows:<7} spark={a:6.2f}s sql={b:6.2f}s {note}", flush=True)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
