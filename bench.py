"""Benchmark: headline queries, one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select
data and cores. Each query is run to the end once to warm up, then timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from leakscan_spark.plans import catalog
from leakscan_spark.session import local_session

HEADLINE = (
    "custom_rule_findings", "builtin_rule_findings", "has_secrets", "redact_text", "suppression_split",
    "engine_union", "baseline_filter", "overall_risk", "top_rules", "notify_summary", "json_results",
    "vulnerability_drafts", "issue_dedup", "text_to_issue", "command_policy", "tool_event_decisions",
    "tool_output_redaction", "audit_verify", "audit_prune_reseal", "audit_query_last_n", "url_extract",
    "bundle_summary", "diff_findings", "stream_scan", "stream_chain_append",
)


def run(query, spark, sf_dir: str) -> float:
    start = time.time()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registry = catalog.registry()
    times = {}
    for name in HEADLINE:
        run(registry[name], spark, sf_dir)
        times[name] = round(run(registry[name], spark, sf_dir), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
