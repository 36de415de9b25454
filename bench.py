"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the cores. Each
query is built and run to a sink that discards its rows; BENCH_REPEAT (default 1) keeps the best run.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factloom.plans.registry import catalogue  # noqa: E402
from factloom.session import local_session  # noqa: E402

HEADLINE = (
    # facts
    "query_facts",
    "query_facts_target_name",
    "facts_for_entity",
    "graph_facts",
    "graph_stats",
    "facts_as_of",
    "facts_by_label",
    "top_facts_per_entity",
    # curation
    "expired_commitments",
    "upgrade_confidence",
    "supersede",
    "conflicts",
    "transition_chain",
    # records
    "email_records",
    "issue_records",
    "history_changes",
    "dedup_records",
    "apply_triage",
    "query_records",
    "communications_of_all",
    # build, validation, resolution
    "commit_entities",
    "commit_facts",
    "fact_errors",
    "resolve_entities",
    # traversal and bundles
    "connections",
    "shortest_path",
    "entity_context",
    "open_blockers",
    # vectors, usage, evaluation
    "vector_search",
    "usage_by_record",
    "fact_scores",
    "match_facts",
    "er_scores",
    # streams
    "stream_dedup",
    "stream_current_facts",
)


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    scratch = tempfile.mkdtemp(prefix="factloom-bench-")
    spark = local_session(cpus, "factloom-bench", **{"spark.checkpoint.dir": scratch})
    spark.conf.set("spark.sql.shuffle.partitions", cpus)
    queries = catalogue()
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    queries["query_facts"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeat):
            start = time.perf_counter()
            queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
