"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query builds its own logical tables: nothing is carried over between them.
"""

import json
import os
import sys
import time

from vulnloom.plans import load_all
from vulnloom.session import build_session

HEADLINE = [
    "top_products_with_score", "graph_stats", "products_of_cve", "page_rank", "product_scores", "sharing_matrix",
    "trace_impact", "forecast_product_lines", "backtest_points", "grid_search", "upsert_merge_fields",
    "firmware_exposure", "rule_matches", "recent_vendor_cves", "vectors_similar_dot",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        registry.forget()
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
