"""Headline queries on one data folder; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    # stage tables first: each of these pays for its own stage, later ones read what was written
    "bars_supplier_month", "momentum_screen", "bars_weekly", "moving_averages", "z_robust", "component_blend",
    "state_softmax", "theme_score",
    # operators on top
    "roll_mean_std", "roll_quantile", "pct_rank", "pct_rank_bucketed", "robust_z", "group_rank_nation", "dq_firewall",
    "ic_summary", "walk_forward_ic", "anomaly_summary", "snapshot_view", "themes_view",
    # the evaluation of 117 scores at six horizons, and the scoring stages on supplier days (rows grow with the tables)
    "full_oos_summary", "features_supplier_day", "z_supplier_day", "score_supplier_day",
)
#: queries whose rows a second are reported, too
GROWING = ("features_supplier_day", "z_supplier_day", "score_supplier_day")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from panelwave.plans import queries as q

    registered = q.queries()
    times: dict[str, float] = {}
    rates: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        out = registered[name](spark, sf_dir)
        out.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if name in GROWING:
            rates[name] = round(out.count() / times[name])
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "rows_per_sec": rates, "sf": Path(sf_dir).name,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
