"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "classify_events", "rule_matches", "threshold_sliding", "cooldown_fires", "retrieve_evidence",
    "evidence_auth", "readiness_report", "case_review", "case_report", "hunt_report", "stream_detect",
]


def main() -> None:
    from authloom.session import builder
    from authloom.workload import tables
    from authloom.workload.queries import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (builder("bench").master(f"local[{cpus}]")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g")
             .config("spark.checkpoint.dir", shared)
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    # stage tables that the queries read are inputs, not part of the timing; hunt_report starts from
    # raw lines and writes its own
    for stage in (tables.auth_lines, tables.auth_events, tables.case_evidence, tables.cases,
                  tables.replies, tables.cited_refs, tables.chain):
        stage(spark, sf)
    lines = tables.auth_lines(spark, sf).count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(1 if name.startswith(("stream", "hunt")) else 2):
            start = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline queries, best of two", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf.rsplit("sf", 1)[-1],
        "lines_per_second": round(lines / seconds["classify_events"]), "cpus": int(cpus),
    }))
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
