"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables and ``BENCH_CPUS`` the cores.  Each query runs to a
sink that keeps nothing; the first run of all warms up, the second is timed.
"""
from __future__ import annotations

import json
import os
import time
from pathlib import Path

from checks.compare import local_session
from checks.queries import QUERIES

HEADLINES = [
    "flag_long_text", "positives_by_period", "cohort_table", "feature_rows", "elected_by_year",
    "profile_frequencies", "category_summary", "event_rate_quantiles", "quantile_bins",
    "collapse_rows", "union_extracts", "parse_date_age", "one_hot_first", "balanced_weights",
    "vif_two", "roc_points_fine", "auc_gini", "cutoff_sweep", "evaluate_summary", "logit_table",
    "office_logit", "forest_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores)
    seconds: dict[str, float] = {}
    for turn in ("warm-up", "timed"):
        for name in HEADLINES:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if turn == "timed":
                seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
