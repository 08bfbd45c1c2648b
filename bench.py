"""Benchmark: headline queries on the fifteen-table model at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The driver tables are turned into the fifteen tables once and written as
Parquet in the deployment layout (document headers and lines bucketed by the
document key, sources.layout); every query then runs on those stored tables.  Each query runs once to warm up and BENCH_REPS (default 3) more times;
the median is reported.  Execution is forced with the no-op sink, so nothing is
collected to the driver.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from depotline.plans.catalog import QUERIES  # noqa: E402
from depotline.session import local_session, new_folder  # noqa: E402
from depotline.sources.fixture import fixture_tables  # noqa: E402
from depotline.sources.layout import save_bucketed  # noqa: E402

HEADLINE = [f"r{i:02d}" for i in range(1, 21)] + ["l04_active_purchases", "l01_active_sales",
                                                   "l09_unpaid_purchases", "x01_stock_reconcile",
                                                   "w03_transfer_admission"]


def _key(prefix: str) -> str:
    return next(k for k in QUERIES if k == prefix or k.startswith(prefix + "_"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    default_parts = cpus if cpus.isdigit() else "8"
    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", default_parts)),
                          app="depotline-bench")
    # Written tables go to a fresh folder under the shared checkpoint folder.
    scratch = new_folder(spark, "bench")

    # The fifteen tables in the deployment layout: documents bucketed by their key.
    buckets = int(os.environ.get("BENCH_BUCKETS", default_parts))
    t0 = time.time()
    tables = save_bucketed(spark, fixture_tables(spark, sf_dir), f"bench_{uuid.uuid4().hex[:8]}",
                           os.path.join(scratch, "tables"), buckets)
    build_sec = time.time() - t0

    timings: dict[str, float] = {}
    for prefix in HEADLINE:
        key = _key(prefix)
        op = QUERIES[key].operator

        def run() -> float:
            start = time.time()
            op(tables).write.format("noop").mode("overwrite").save()
            return time.time() - start

        run()
        timings[key] = round(statistics.median(run() for _ in range(reps)), 3)

    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total_median",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "fixture_build_sec": round(build_sec, 3),
        "cpus": cpus,
        "reps": reps,
        "layout": f"bucketed({buckets})",
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
