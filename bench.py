"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from kinloom.plans import inputs  # noqa: E402
from kinloom.plans.queries import QUERIES  # noqa: E402
from kinloom.session import build_session  # noqa: E402

# Stages a query needs are built inside its own time, except where one is listed
# right after the query that built it (scores after link, graph after link).
HEADLINE = (
    "baseline_metrics",
    "blocking_rule_counts",
    "candidate_pairs",
    "fixed_param_scores",
    "master_ids",
    "threshold_sweep",
    "graph_summary",
    "bridges",
    "profile_build",
    "linked_profile_build",
    "engagement_tiers",
    "service_coverage",
    "peer_prevalence",
    "search",
    "dossier_records",
    "field_agreement",
    "features",
    "forest_scores",
    "detector_comparison",
    "generated_records",
    "trained_link",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    inputs.forget_stages()
    took: dict[str, float] = {}
    for name in chosen:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 2)
        print(f"{name}: {took[name]}s", file=sys.stderr, flush=True)
    line = {
        "metric": "total wall-clock of the headline queries",
        "value": round(sum(took.values()), 2),
        "unit": "sec",
        "queries": took,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
