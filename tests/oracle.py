"""Run registered queries next to their SQL and compare the rows.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(con, df, sql: str) -> tuple[str, int]:
    got_names, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_names, want = _sorted_rows([d[0] for d in rel.description], rel.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}", len(got)
    return "", len(got)


def main() -> int:
    from shiftwise.plans import all_queries, all_sql
    from shiftwise.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--cpus", default="8")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"{TESTDATA}/sf{args.sf}"
    spark = local_session(args.cpus)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql, failed = duck(sf_dir), all_queries(), all_sql(), 0
    wanted = [q for q in queries if not args.names or any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in args.names)]
    for name in wanted:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                problem, n = compare(con, df, sql[name])
            else:
                problem, n = "", len(df.collect())
        except Exception as e:
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        failed += bool(problem)
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:32s} {n:8d} rows {time.time() - t:6.2f}s {problem}", flush=True)
    print(f"{len(wanted) - failed}/{len(wanted)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
