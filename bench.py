"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from semdrift.session import local_session  # noqa: E402

HEADLINES = [
    "a05_corpus_drift",
    "t13_clean_text",
    "m_text_stats",
    "h03_visible_text",
    "e04_hash_embedding",
    "e11_top_k_similar",
    "g05_metadata_frame",
    "a05_yearly_drift",
    "x04_cluster_stats",
    "r06_projection",
    "r07_nearest_neighbours",
    "c01_kmeans_labels",
    "c03_silhouette",
    "c05_dbscan_labels",
    "p05_unique_batches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    from semdrift.plans.catalog import load

    queries, _ = load()
    wanted = sys.argv[1:] or HEADLINES

    def once(key: str) -> float:
        begin = time.perf_counter()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for key in wanted:
        once(key)  # warm-up
        seconds[key] = round(sorted(once(key) for _ in range(runs))[runs // 2], 3)
    print(json.dumps({
        "metric": "headline query wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
