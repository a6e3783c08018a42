"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from gavilla.plans import catalog
from gavilla.session import build_session

HEADLINE = [
    "load_metrics", "dense_id", "ngram_counts", "minhash_signature", "lsh_star_edges", "component_labels",
    "cluster_aggregates", "vocabulary", "tfidf_weights", "centroids", "cosine_topk", "ivf_topk", "core_distance",
    "density_clusters", "average_tree",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_metrics(spark, sf).collect()  # session and code warm-up
    times = {}
    for name in names:
        start = time.time()
        catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 2)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 2), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
