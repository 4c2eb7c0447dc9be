"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads,
BENCH_QUERIES an optional comma-separated choice.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from lopside.catalog import QUERIES
from lopside.session import get_spark

HEADLINE = [
    "q_features", "q_medians", "q_split", "q_undersample", "q_bags", "q_prepared",
    "q_metrics_by_segment", "q_auc", "q_sweep", "q_eval_configs", "q_attach_params",
    "q_mutual_info", "q_knn_l1", "q_knn_l2", "q_knn_vote", "q_smote", "q_enn", "q_tomek",
    "q_score", "q_gnb_pipeline", "q_nb_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.lopside.input.partitions": cpus,
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"), "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["q_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # The noop sink evaluates every column of every row and moves none of
        # it to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "patient_rows": rows,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
