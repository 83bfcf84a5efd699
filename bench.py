"""Headline queries, timed.  Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from inkwell.plans.catalog import CATALOG  # noqa: E402
from inkwell.session import local_session  # noqa: E402

HEADLINE = [
    "redaction_summary", "normalise_text", "classify_documents", "classify", "extract_fields", "validate_identifiers",
    "statement_rows", "infer_direction", "overlap_findings", "alignment_findings", "risk_score", "field_confidence",
    "cross_check_outcomes", "retention_plan", "owner_stats", "line_search", "replay_limits", "vault_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session("bench", cores=cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8), memory="16g")
    CATALOG["owner_stats"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(repeats):
            started = time.time()
            CATALOG[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - started)
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
