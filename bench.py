"""Benchmark: headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs ``$BENCH_RUNS`` times (default 2) and counts with its best time. Results
are computed in full but not sent to the driver. ``stages`` times the steps of a whole load over
the same trips apart from landing them and creating the tables, with ``stage_rows`` rows; they
do not count in ``value``.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tripledger import names as n
from tripledger.checks.queries import LANDED_AS, PASSING, QUERIES, land
from tripledger.checks.scratch import lake
from tripledger.operators import rollups
from tripledger.plans.raw_load import RawLoad, load_raw
from tripledger.plans.trusted_load import TrustedLoad, load_trusted
from tripledger.session import local_session
from tripledger.sources.fixtures import trips

HEADLINE = [
    "monthly_amount",
    "monthly_amount_all",
    "hourly_passengers",
    "trusted_profile",
    "clean_profile",
    "coverage_profile",
    "conform",
    "staged_batch",
    "row_verdict",
    "quality_metrics",
    "error_reasons",
    "split_valid",
    "quarantine_rows",
    "dedupe_exact",
    "duplicate_keys",
    "replace_month",
    "merge_trusted",
    "merge_trusted_hot_key",
    "raw_load",
    "trusted_load",
]


def stages(spark: SparkSession, sf_dir: str) -> tuple[dict[str, float], int]:
    """Seconds of each stage of a load over all months, and the rows it loads."""
    times = {}

    def timed(name: str, action) -> None:
        began = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - began, 3)

    base = land(spark, sf_dir)
    span = trips(spark, sf_dir).agg(F.min(n.MONTH), F.max(n.MONTH), F.count("*")).first()
    first, last = f"{span[0]:%Y-%m}", f"{span[1]:%Y-%m}"
    with lake(spark) as place:
        raw = RawLoad(base, place.raw(), first, last, "2001-12-01 12:00:00", LANDED_AS)
        job = TrustedLoad(place.name("raw"), place.staging(), place.trusted(), place.quarantine(), first, last, PASSING)
        timed("landing_to_raw", lambda: load_raw(spark, raw))
        timed("raw_to_trusted", lambda: load_trusted(spark, job))
        timed("raw_to_trusted_again", lambda: load_trusted(spark, job))
        trusted = spark.table(place.name("trusted"))
        timed("question_1", lambda: rollups.monthly_amount(trusted, 1997, (1, 5)).collect())
        timed("question_2", lambda: rollups.hourly_passengers(trusted, 1997, 5).collect())
    return times, span[2]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    QUERIES[HEADLINE[0]](spark, sf_dir).collect()  # starts the workers
    for key in HEADLINE:
        tries = []
        for _ in range(runs):
            began = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            tries.append(time.perf_counter() - began)
        times[key] = round(min(tries), 3)
    steps, rows = stages(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "stages": steps,
                "stage_rows": rows,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
