"""Headline queries on one machine, before result rounding; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from airloom.plans.catalog import PLAIN
from airloom.session import build_session

HEADLINE = (
    "impute_short_gaps",
    "reference_features",
    "training_set",
    "purge_split",
    "describe_split",
    "enrich_forecast",
    "alert_episodes",
    "alert_episodes_series",
    "forecast_summary",
    "upsert",
    "sync_report",
    "dataset_digest",
    "completeness_report",
    "per_horizon_metrics",
    "error_distribution",
    "incident_lifecycle",
    "reference_readiness",
    "stream_hourly",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    PLAIN["latest_event_time"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        PLAIN[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
