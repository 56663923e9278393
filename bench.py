"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tenura.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "survival_dataset",
    "holdout_split",
    "km_by_group",
    "density_by_event",
    "spearman_matrix",
    "cindex_fixed_risk",
    "cox_loglik_fixed_beta",
    "schoenfeld_fixed_beta",
    "hazard_ratios",
    "ph_test",
    "cv_cindex",
    "univariate_cindex",
    "experiment",
    "leakage_audit",
    "text_signals",
    "tfidf_vocab",
    "tfidf_weights",
    "tfidf_svd",
    "pca_embedding",
    "ablation_additive",
    "text_survival_dataset",
    "ingest_reviews",
    "ingest_items",
    "align_batches",
    "signal_fallbacks",
    "signals_stream",
    "dense_vectors",
)

#: Also timed on the next smaller tables, where these lie beside the folder: seconds there are set against
#: seconds here, for ten times the rows.
GROWTH = ("survival_dataset", "km_by_group", "spearman_matrix", "text_survival_dataset", "text_signals", "tfidf_weights")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # one small query first, so that starting the JVM and the Python workers is not measured
    QUERIES["text_signals"](spark, sf_dir).limit(1).collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    smaller = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    growth: dict[str, float] = {}
    if scale == "0.1" and os.path.isdir(smaller):
        for name in [n for n in GROWTH if n in times]:
            start = time.perf_counter()
            QUERIES[name](spark, smaller).write.format("noop").mode("overwrite").save()
            growth[name] = round(times[name] / (time.perf_counter() - start), 2)
    print(
        json.dumps(
            {
                "metric": "total_headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "growth_from_sf0.01": growth,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
