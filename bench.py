"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with seconds per query.

Each query is forced in full with the ``noop`` sink (every row computed,
nothing collected to the driver). One warm-up query runs first so JVM start
and code loading are not charged to the first measurement.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "page_text", "page_gate", "url_screen", "resolve_inputs", "content_category", "summary_prompts",
    "meeting_prompts", "diff_prompts", "route_requests", "request_payloads", "openai_text", "reframed_text",
    "recover_json", "typed_summaries", "typed_meetings", "catalogue_merge", "template_defaults", "lint_catalogue",
    "lookup_cascade", "search_topk", "command_screen", "expand_templates", "redirect_chains", "assemble_stream",
    "summary_pipeline",
]


def main() -> None:
    from textloom.plans.queries import QUERIES
    from textloom.session import ensure_checkpoint_dir, get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("textloom-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    ensure_checkpoint_dir(spark)
    QUERIES["bound_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
