"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "momentum_leaders", "technicals_series", "wilder_rsi", "reconciled_history", "store_merged_rows",
    "return_metrics", "basket_stats", "moving_average_rule", "ladder_proof", "drawdown_episodes", "signal_rank_ic",
    "factor_attribution", "diversifier_screen", "forced_flow", "signal_weights", "rebalance_funding",
    "scenario_stress", "option_screen_summary", "claim_resolution", "forecast_scorecard", "decision_funnel",
    "phrase_sweep", "filing_passages", "matched_news", "tick_bars",
]


def main() -> None:
    from tidegauge.plans import catalog
    from tidegauge.plans.registry import run
    from tidegauge.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINES
    catalog.load()
    spark = build_session(f"local[{cpus}]", app="bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in only:
        start = time.perf_counter()
        run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
