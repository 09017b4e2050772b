"""Times the headline queries and prints one JSON line.

Every query runs once on the smallest data first, so that the numbers show the work on the data and
not the start of the JVM, its compiler and the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from keyrhythm.catalog import QUERIES
from keyrhythm.session import local_session

HEADLINE = ["group_profile", "wide_profile", "derive_transitions", "feature_table", "knn_predict", "session_features",
            "stratified_split", "auc", "feature_statistics", "model_report"]


def run(spark, name: str, folder: str) -> None:
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["class_balance"](spark, folder).collect()
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in HEADLINE:
            run(spark, name, small)
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(spark, name, folder)
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
