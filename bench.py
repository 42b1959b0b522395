"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import time

from privatrail.plans import QUERIES
from privatrail.session import local_session
from privatrail.sources.model import model

HEADLINE = [
    "p01_standalone_patterns",
    "p14_redaction",
    "p25_corpus_profile",
    "s15_html_text",
    "t11_tracking_analysis",
    "c03_dark_patterns",
    "h01_history_latest",
    "h01_latest_line_per_order",
    "h11_tally",
    "h12_activity_cube",
    "g01_rule_state",
    "r04_risk",
    "l03_best_clauses",
    "l05_collected_categories",
    "r15_rate_limit",
    "r20_decisions",
    "f07_form_intent",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8, "bench")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    times = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    # the scan for all patterns over its whole table of texts
    chars = model(spark, sf_dir, "texts").selectExpr("sum(octet_length(text)) AS n").first()["n"]
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "text_scan_mib_per_sec": round(chars / 1048576 / times["p25_corpus_profile"], 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
