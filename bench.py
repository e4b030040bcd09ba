"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from tonnage.catalog import run
from tonnage.session import local_session

# the stages of the analytical build, its point-in-time features, diagnostics and checks
HEADLINE = (
    "mt1_order_performance",
    "mt2_line_shift_performance",
    "mt4_quality_summary",
    "mt8_loss_pareto",
    "pt1_pre_order_snapshot",
    "pt3_asset_window_snapshot",
    "pt6_next_window_labels",
    "dg2_mix_adjustment",
    "dg3_spc_tbh",
    "dg5_process_interactions",
    "dq4_foreign_keys",
    "dq14_reconciliations",
    "ml1_temporal_split",
    "mx4_roc_auc",
    "sc9_line_skyline",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    run("dm3_dim_line", spark, sf_dir).collect()  # JVM warm-up
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    result = {"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
