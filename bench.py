"""Time the headline queries and print one JSON line.

BENCH_SF_DIR chooses the tables, BENCH_CPUS the local cores. Each query runs once to warm up and once measured;
results are fully computed and thrown away.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pairsieve.catalog import QUERIES
from pairsieve.session import local_session

HEADLINE = [
    "subset_accuracy",
    "section_scores",
    "ablation_report",
    "score_quantiles",
    "random_sample",
    "normalised_vectors",
    "pooled_mean",
    "tokens_fitted_right",
    "overlapping_chunks",
    "rendered_conversations",
    "csv_records",
    "greedy_lstsq",
    "greedy_nnls",
    "greedy_by_section",
    "greedy_sweep_two_components",
    "greedy_sweep",
    "greedy_residual",
    "nnls_fit_large_basis",
    "half_space_two_components",
    "half_space_all_components",
    "section_study",
    "section_study_all_components",
    "fitted_scorer",
]


def run(spark, name: str, sf: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("pairsieve-bench", cpus, shared=tempfile.mkdtemp(prefix="run-"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run(spark, name, sf)
        times[name] = round(run(spark, name, sf), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
