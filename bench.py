"""Wall time of the headline queries. Prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.functions.session import get_session, ship_code  # noqa: E402
from tidemark.plans import QUERIES  # noqa: E402

HEADLINE = [
    "describe_numbers",
    "numeric_profile",
    "column_overview",
    "top_values",
    "correlations",
    "quantiles_by_rank",
    "validation_issues",
    "training_report",
    "fill_median",
    "outliers_clipped",
    "label_encoded",
    "label_codes_of_many",
    "label_encoded_many",
    "scaled_robust",
    "full_preparation",
    "undersampled",
    "mutual_information",
    "ks_drift",
    "ks_drift_by_range",
    "kl_drift",
    "category_drift",
    "chi_square_drift",
    "check_alerts",
    "series_changes_by_range",
    "last_many",
    "number_versions",
    "classification_report",
    "roc_auc",
    "regression_report",
    "tumbling_metrics",
    "word_frequencies",
    "stratified_folds",
    "nearest_neighbours",
    "density_clusters",
    "fit_random_forest",
    "fit_linear_regression",
    "streamed_tumbling_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_code()
    names = sys.argv[1:] or HEADLINE
    # One pass over a table starts the executor threads and the code generator.
    QUERIES["value_counts"](spark, sf_dir).collect()
    times = {}
    for name in names:
        start = time.time()
        # Every row is computed and none is kept.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_wall_time", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
