"""Time the headline queries and print one JSON line.

Folder from BENCH_SF_DIR, cores from BENCH_CPUS. Every query is planned, run and fully consumed by a sink that
discards rows, so the time covers the whole result.
"""

from __future__ import annotations

import json
import os
import time

from tokenloom.plans.catalog import QUERIES
from tokenloom.session import build_session

HEADLINE = [
    "raw_tokens",
    "text_chunks",
    "target_budget",
    "label_thresholds",
    "gram_counts",
    "collocation_bigrams",
    "collocation_trigrams",
    "collocation_occurrences",
    "collocation_cluster_table",
    "nearest_centroids",
    "exact_neighbours",
    "kmeans_clusters",
    "external_metrics",
    "silhouette",
    "hierarchy_metrics",
    "hierarchy_alignment",
    "cluster_summary",
    "form_similarity",
    "label_pair_similarity",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cores}]",
        spark__sql__shuffle__partitions=cores,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").count()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
