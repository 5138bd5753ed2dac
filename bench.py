"""Times headline queries on one machine and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from varloom.catalog import QUERIES  # noqa: E402
from varloom.session import build_session  # noqa: E402

# One query per step of the study, named by what the step does.
HEADLINE = (
    "A6_leaderboard",            # lag-regression walk-forward and leaderboard
    "F4_garch_grid",             # variance-model walk-forward
    "F5_egarch_grid",
    "F6_lookback_regression",    # window-model walk-forward
    "B9_validation_sweep",       # hyper-parameter sweep
    "G1_causal_filter",          # regime filter
    "G9_penalty_sweep",          # regime penalty sweep
    "F8_regime_experts",         # regime-conditioned forecasts
    "F9_predictive_draws",       # uncertainty
    "T8_joint_table",            # conditional predictive ability
    "A36_dm_diagnostics",
    "T15_coverage_suite",        # coverage tests
    "A32_master_table",          # combined table
    "V4_verification_exit",      # verification gate
    "A1_trade_variance",         # raw rows to daily variance
    "A2_subsampled_variance",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "varloom-bench", int(cpus) if cpus.isdigit() else 8)
    QUERIES["S3_daily_ohlc"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
