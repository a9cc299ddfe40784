"""Headline queries, median of warm runs; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from attestra.plans.catalog import QUERIES
from attestra.session import local_session

HEADLINE = [
    "A12_pair_summary",
    "A13_semantic_hash",
    "E8_changes",
    "W1_revision_chain",
    "E10_freshness",
    "A3_source_diversity",
    "A5_evidence_inventory",
    "A6_coverage_matrix",
    "E3_source_registry",
    "E20_verify_citations",
    "E15_derived_metrics",
    "E17_extract_assertions",
    "E18_resolve_addresses",
    "J14_review_gate",
    "A8_provider_state",
    "G4_connected_components",
    "A16_diversity_vector",
    "Q1_sourcing",
    "H11_audit_summary",
    "U5_combine_events",
]


def run(fn, spark, sf: str) -> float:
    start = time.time()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    wanted = sys.argv[1:] or HEADLINE
    folder = tempfile.mkdtemp(prefix="bench-")  # one machine: shared by all of the session
    spark = local_session("bench", cores, int(cores), folder)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in wanted:
        run(QUERIES[name], spark, sf)  # warm-up
        times[name] = round(statistics.median(run(QUERIES[name], spark, sf) for _ in range(repeats)), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, sum of median warm runs", "value": total, "unit": "sec", "queries": times, "sf": sf.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
