"""Time the registered queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma separated, default all).
Each query is planned and its whole result written to a no-op sink; the first query is run once before for warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from shiftwise.plans import all_queries
from shiftwise.session import local_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries = all_queries()
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(queries)
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("class_stats")
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in wanted:
        try:
            times[name] = run(name)
        except Exception as e:
            failed[name] = str(e)[:200]
        print(f"{name} {times.get(name, failed.get(name))}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "failed": failed, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus), "spark": spark.version,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
