"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from marketloom import queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "panel_returns", "prim_sma", "prim_beta60", "op_ewma", "op_rolling_corr", "formula_depth4", "preprocess", "rank_ic_stats", "ls_stats", "decile_returns",
    "turnover", "signal_decay", "redundancy", "evaluate_factor", "aggregate_linear", "hedge_exposure", "hedge_backtest_stats", "portfolio_vol30", "portfolio_vol_ewma",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries.panel_returns(spark, SF_DIR).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
