"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import importlib
import importlib.util
import json
import os
import statistics
import time
from pathlib import Path

from larkspan import session
from larkspan.plans import catalog

HEADLINE = ("pricing_summary", "revenue_forecast", "shipping_priority", "local_supplier_volume", "promo_effect", "large_orders", "eligible_lookup", "band_conversion", "by_kind_year", "asof_prev_purchase", "interval_join", "cube_flags", "session_batch", "cosine_topk", "array_funcs", "exact_dup_docs")

#: Timed runs of a query, of which the median counts.
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(f"local[{cpus}]", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = dict(catalog.QUERIES)
    names = list(HEADLINE)
    if importlib.util.find_spec("larkspan.llm"):
        queries |= importlib.import_module("larkspan.llm.queries").QUERIES
        names += ["op4_benchmark_decontamination", "op6_quality_rules", "op7_sharding", "op11_hard_negatives", "op13_filter_audit"]
    times = {}
    for name in names:
        took = []
        for _ in range(1 + RUNS):  # the first run compiles code
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
