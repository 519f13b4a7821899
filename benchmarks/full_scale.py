"""The whole load at the size of five monthly files, about 15 million rows.

``python benchmarks/full_scale.py [SF_DIR] [COPIES]`` multiplies the supplied trips into the
months 2001-07 to 2001-11, lands them as files, and times each stage on ``local[$BENCH_CPUS]``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tripledger import names as n  # noqa: E402
from tripledger.checks.scratch import lake  # noqa: E402
from tripledger.operators import rollups  # noqa: E402
from tripledger.operators.rules import Limits  # noqa: E402
from tripledger.operators.writers import arrange  # noqa: E402
from tripledger.plans.raw_load import RawLoad, load_raw  # noqa: E402
from tripledger.plans.trusted_load import TrustedLoad, load_trusted  # noqa: E402
from tripledger.session import local_session, work_folder  # noqa: E402
from tripledger.sources.fixtures import trips  # noqa: E402

FIRST, LAST = "2001-07", "2001-11"


def enlarged(spark: SparkSession, sf_dir: str, copies: int) -> DataFrame:
    """Each trip once per copy, some minutes apart, spread over five months."""
    months = F.months_between(n.MONTH, F.lit("1995-01-01")).cast("int") % 5
    month = F.add_months(F.lit("2001-07-01").cast("date"), months)
    days = F.datediff(F.col("month"), F.col(n.MONTH))
    moved = trips(spark, sf_dir).withColumn("month", month).withColumn("days", days)
    shift = F.make_dt_interval(F.col("days"), F.lit(0), F.col("copy"))
    return (
        moved.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumns({c: F.col(c) + shift for c in (n.PICKUP, n.DROPOFF)})
        .withColumn("month", F.date_format("month", "yyyy-MM"))
        .drop("days", "copy", n.MONTH, n.LOADED)
    )


def main(sf_dir: str, copies: int) -> None:
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, "full-scale")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}

    def timed(name: str, action) -> object:
        began = time.perf_counter()
        result = action()
        times[name] = round(time.perf_counter() - began, 2)
        return result

    base = work_folder(spark, "landing")
    rows = enlarged(spark, sf_dir, copies)
    arrange(rows, ("month",)).write.mode("overwrite").partitionBy("month").parquet(base)
    with lake(spark) as place:
        raw = RawLoad(base, place.raw(), FIRST, LAST, "2001-12-01 12:00:00", "month={year}-{month:02d}")
        timed("landing_to_raw", lambda: load_raw(spark, raw))
        job = TrustedLoad(place.name("raw"), place.staging(), place.trusted(), place.quarantine(),
                          FIRST, LAST, Limits("2001-12-31 00:00:00"))
        timed("raw_to_trusted", lambda: load_trusted(spark, job))
        trusted = spark.table(place.name("trusted"))
        timed("question_1", lambda: rollups.monthly_amount(trusted, 2001, (7, 11)).collect())
        timed("question_2", lambda: rollups.hourly_passengers(trusted, 2001, 10).collect())
        stored = trusted.count()
        timed("raw_to_trusted_again", lambda: load_trusted(spark, job))
        assert spark.table(place.name("trusted")).count() == stored
        print(json.dumps({"rows": spark.table(place.name("raw")).count(), "trusted": stored,
                          "cpus": cpus, "seconds": times}))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1", int(sys.argv[2]) if len(sys.argv) > 2 else 25)
