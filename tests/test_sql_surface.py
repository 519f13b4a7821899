"""The SQL functions give what the operators give."""

import pytest
from pyspark.sql import functions as F

from tripledger import names as n
from tripledger.checks.queries import FAILING, QUERIES, flagged
from tripledger.operators import metrics, rules, sql_surface

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=["coded", "documented"])
def registered(spark, request):
    whole = flagged(spark, SF, FAILING, request.param)
    # Core columns with every fault, as text, and what no column can hold.
    kinds = dict(whole.dtypes)
    faults = spark.range(6).select(*[
        F.when(F.col("id") == k, F.lit(None if k % 2 else "x7")).otherwise(F.lit(good)).alias(c)
        for k, (c, good) in enumerate([(n.VENDOR, "1"), (n.PICKUP, "2024-01-01 00:00:00"), (n.DROPOFF, "2024-01-01 00:10:00"),
                                       (n.PASSENGERS, "2"), (n.AMOUNT, "12.5")])
    ])
    rows = whole.select(*[F.col(c).cast("string") for c in n.CORE]).unionByName(faults.select(*n.CORE))
    rows.createOrReplaceTempView("some_trips")
    assert set(n.CORE) <= set(kinds)
    sql_surface.register(spark, "some_trips", FAILING, request.param)
    return rows, request.param


def same(a, b):
    assert a.columns == b.columns
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_one_statement_equals_the_operators(spark, registered):
    rows, pack = registered
    want = rules.with_rules(rows, FAILING, pack)
    assert same(spark.sql("SELECT * EXCEPT (flags) FROM flagged_trips()"), want)
    told = want.select(*n.CORE, rules.reasons(pack).alias("why"), rules.error_class(pack).alias("kind"))
    core = ", ".join(n.CORE)
    assert same(spark.sql(f"SELECT {core}, trip_reasons(flags) AS why, trip_class(flags) AS kind FROM flagged_trips()"), told)
    report = metrics.report_long(metrics.quality_metrics(want, pack), pack)
    assert same(spark.sql("SELECT * FROM trip_report()"), report)


def test_variables_change_later_statements_and_plans_stay_in_the_engine(spark, registered):
    before = spark.sql("SELECT sum(falha_duracao_excessiva) AS c FROM flagged_trips()").first().c
    spark.sql("SET VARIABLE trip_max_seconds = 1")
    query = spark.sql("SELECT sum(falha_duracao_excessiva) AS c FROM flagged_trips()")
    assert query.first().c > before
    assert "Python" not in query._jdf.queryExecution().toString()


def test_registered_queries_agree(spark):
    assert same(QUERIES["sql_flagged_rows"](spark, SF), QUERIES["flagged_rows"](spark, SF))
