"""Timings of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from tiersmith.plans.driver_queries import QUERIES  # noqa: E402
from tiersmith.session import get_spark  # noqa: E402

HEADLINE = [
    "tier_summary",
    "catalogue_clean",
    "clean_html",
    "quality_report",
    "keyword_flags",
    "date_parts_filter",
    "top_tokens",
    "multi_hot",
    "tfidf_vectors",
    "robust_scale",
    "five_number",
    "corr_prune",
    "strat_split",
    "kfold",
    "macro_metrics",
    "argmax_per_group",
    "friedman",
    "wilcoxon",
    "knn_in_class",
    "tomek_links",
    "smotenc",
    "pls_scores",
    "calibration_grid",
    "train_predict",
    "out_of_fold",
    "shapley",
    "catalogue_training",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        master=f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_driver_memory="16g",
        spark_ui_enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["class_weights"](spark, sf_dir).collect()  # JVM start-up stays out of the first timing
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
