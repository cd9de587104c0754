"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data
and the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairlens.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "ag01_summarize",
    "ag02_summarize_measures",
    "ag03_standard_summaries",
    "ag05_baseline_vs_primed",
    "ag14_priming_effects_all",
    "ag23_generation_bias",
    "ag38_strict_audit",
    "w01_counterbalance",
    "w02_zscore_by_group",
    "w04_baseline_shift",
    "st01_paired_effect",
    "st06_one_sample_p",
    "st07_paired_tests",
    "st08_bootstrap_poisson",
    "st08_bootstrap_multinomial",
    "st09_sign_flip",
    "st15_ols_hc3",
    "st15_random_intercept",
    "st24_fitted_shift",
    "j09_edit_neighbors",
    "j14_assign_opposite",
    "ar05_explode_tokens",
    "ar16_category_predictability",
    "ar19_cosine_topk",
    "s01_ngram_score",
    "tx23_label_structure",
    "tx31_review_queue",
    "tx34_export_prompts_long",
    "tx42_build_items",
    "tx45_lexicon_audit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in sys.argv[1:] if n in QUERIES] or HEADLINE
    # One small run first, so that no query pays for the start of the JVM.
    QUERIES["ag01_summarize"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(found.group(1)) if found else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
