"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times (3) into a sink
that keeps nothing; the median counts. ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from brindle.plans import catalog  # noqa: E402
from brindle.session import local_session  # noqa: E402

HEADLINE = (
    "crowd_bucket", "crowd_person_sd", "crowd_metric", "crowd_metric_normalised", "crowd_type_metric", "bucket_ties",
    "emotion_totals", "emotion_share", "emotion_running_avg", "emotion_change_points", "emotion_weighted", "emotion_latest",
    "fuzzify_quantity_long", "fuzzify_discount_wide", "fuzzy_and_or", "fuzzy_power", "fuzzy_power_normalised", "fuzzy_rules_table", "fuzzy_customer_grade",
    "rule_single", "rule_join_cascade", "rule_fixpoint",
    "feed_dedup", "article_dedup_scoped", "recency_filter", "topic_anti", "topic_semi", "batch_50", "qa_any", "tags_sorted", "md_escape",
    "article_markdown", "strategy_sentence", "html_title", "html_assemble", "json_props", "json_repair", "llm_batch_stub", "html_to_markdown",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", 3))
    spark = local_session("brindle-bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = catalog.queries(), {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            found[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took[1:]), 4)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf"), "cpus": cores}))


if __name__ == "__main__":
    main()
