"""Times the headline queries at one scale and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from strandwise.plans.catalog import QUERIES
from strandwise.session import build_session

HEADLINE = (
    "start_precision_recall",
    "differential_starts",
    "recall_at_fp_budget",
    "rank_areas",
    "near_neighbour_win_rate",
    "bootstrap_intervals",
    "merge_spans",
    "assign_windows",
    "gene_track_totals",
    "candidate_score_variants",
    "offset_profile",
    "spliced_track",
    "box_mean_features",
    "enumerate_codons",
    "profile_kl",
    "replicate_scorecard",
    "peak_summary",
    "ensemble_scores",
    "p_site_placement",
)


def main() -> None:
    """Run every headline query once after a warm-up and report seconds."""
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.log.level": "ERROR",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    QUERIES["track_pileup"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf.rstrip("/"))
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
