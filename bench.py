"""Benchmark: run the headline registered queries at $BENCH_SF_DIR on
local[$BENCH_CPUS] and print one JSON line.

Each query is planned from the parquet files and written to Spark's ``noop``
sink, so the whole result is computed on the executors and nothing is
collected to the driver.  ``BENCH_QUERIES=a,b,c`` overrides the list;
``BENCH_QUERIES=all`` runs every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "buy_recommendations", "clearance_alerts", "reorder_recommendations", "portfolio_summary",
    "return_rate_analysis", "trending_skus", "wishlist_demand_proxy", "supply_chain_health",
    "gmroi", "similar_skus_all", "feature_matrix", "demand_acf", "zero_day_analysis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["BENCH_CPUS"] = cpus
    from framewise.plans import REGISTRY
    from framewise.session import get_session
    from framewise.sources.adapters import adapters

    spark = get_session(master=f"local[{cpus}]")
    wanted = os.environ.get("BENCH_QUERIES")
    names = list(REGISTRY) if wanted == "all" else (wanted.split(",") if wanted else HEADLINE)
    names = [n for n in names if n in REGISTRY]
    times: dict[str, float] = {}
    for name in names:
        t = time.time()
        df = REGISTRY[name].build(adapters(spark, sf_dir))
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"# {name} {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
