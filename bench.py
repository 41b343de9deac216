"""Headline queries, each run to its last row; prints one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local cores. Shared silver tables are built
inside the first query that needs them, so the sum counts every build once.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tracelake.plans import catalog  # noqa: E402
from tracelake.runtime import local_session, ship  # noqa: E402

HEADLINE = (
    "ses_problem_summary", "ses_follow_ups", "ses_file_involvement", "ses_list", "ses_agent_graph",
    "rep_attempts", "rep_verdict", "rep_tokens_in_window", "rep_gap_quantiles",
    "eva_evaluate_series", "ing_duplicates", "ing_report", "ans_resolve", "evd_answer_support", "evd_coverage",
    "top_shared_source_edges", "ckp_select", "fn_failure_signature", "san_redact_secrets", "str_verify_first_batch",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executors
    queries, times = catalog.queries(), {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
