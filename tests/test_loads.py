from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tripledger import names as n
from tripledger.operators import gates, rollups
from tripledger.operators.conform import EmptyInputError, SchemaError
from tripledger.operators.rules import Limits
from tripledger.operators.staging import stage
from tripledger.operators.writers import append
from tripledger.plans.raw_load import RawLoad, conform_raw, load_raw
from tripledger.plans.trusted_load import TrustedLoad, load_trusted
from tripledger.session import work_folder
from tripledger.sources import contracts
from tripledger.sources.landing import month_path
from tripledger.sources.ledger import newest_load

LANDED = ("VendorID int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
          "passenger_count long, Airport_Fee double, surplus string")


def land(spark, base, month, vendors, schema=LANDED):
    start = datetime(2023, month, 5, 8)
    rows = [(v, start, start + timedelta(minutes=9), 2, 1.25, "x") for v in vendors]
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(month_path(base, 2023, month))


def raw_job(lake, base, **changes):
    lake.raw()
    return RawLoad(**{**dict(landing=base, table=lake.name("raw"), start="2023-01", end="2023-02",
                             as_of="2023-06-02 01:00:00"), **changes})


def vendors(spark, lake):
    return sorted((r[n.MONTH].month, r.VendorID) for r in spark.table(lake.name("raw")).collect())


@pytest.mark.parametrize("failures", ["stop", "continue"])
def test_raw_load_replaces_months(spark, lake, failures):
    base = work_folder(spark, "landing")
    land(spark, base, 1, [1, 2])
    # The second month spells a name differently and uses other types.
    land(spark, base, 2, [2], LANDED.replace("VendorID int", "vendorid long"))
    job = raw_job(lake, base, failures=failures)
    assert load_raw(spark, job) == {} == load_raw(spark, job)
    assert vendors(spark, lake) == [(1, 1), (1, 2), (2, 2)]
    row = spark.table(job.table).select(*contracts.raw_schema().names).first()
    assert row[n.LOADED] == date(2023, 6, 1) and row.airport_fee == 1.25 and row.tip_amount is None
    land(spark, base, 2, [6])
    load_raw(spark, RawLoad(base, job.table, "2023-02", "2023-02"))
    assert vendors(spark, lake) == [(1, 1), (1, 2), (2, 6)]
    land(spark, base, 2, [1, 6])
    load_raw(spark, RawLoad(base, job.table, "2023-02", "2023-02", cluster=False))
    assert vendors(spark, lake) == [(1, 1), (1, 2), (2, 1), (2, 6)]


def test_a_failing_month_stops_all_or_is_reported(spark, lake):
    base = work_folder(spark, "landing")
    land(spark, base, 1, [1])
    land(spark, base, 3, [2])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_raw(spark, raw_job(lake, base, end="2023-03"))
    assert vendors(spark, lake) == []
    failed = load_raw(spark, raw_job(lake, base, end="2023-03", failures="continue"))
    assert list(failed) == ["2023-02"] and vendors(spark, lake) == [(1, 1), (3, 2)]


def test_empty_months_and_extras(spark, lake):
    base = work_folder(spark, "landing")
    land(spark, base, 1, [])
    land(spark, base, 2, [1])
    with pytest.raises(EmptyInputError, match="2023-01"):
        load_raw(spark, raw_job(lake, base))
    with pytest.raises(SchemaError, match="surplus"):
        load_raw(spark, raw_job(lake, base, start="2023-02", extras="fail"))


TRIP = ("VendorID long, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
        "passenger_count double, total_amount double, date_reference date, insertion_date date")
T0 = datetime(2023, 5, 1, 10)
AT = Limits("2023-06-01 12:00:00")
LATER = Limits("2023-06-01 18:00:00")


def trip(minute, vendor=1, amount=20.0, month=5, loaded=date(2023, 6, 1)):
    start = T0 + timedelta(minutes=minute)
    return (vendor, start, start + timedelta(minutes=10), 2.0, amount, date(2023, month, 1), loaded)


def fill(spark, lake, rows):
    append(conform_raw(spark.createDataFrame(rows, TRIP)), lake.raw())


def job(lake, limits=AT, pack="coded", **changes):
    fields = dict(raw=lake.name("raw"), staging=lake.staging(), trusted=lake.trusted(),
                  quarantine=lake.quarantine(pack), start="2023-05", end="2023-05", limits=limits, pack=pack)
    return TrustedLoad(**{**fields, **changes})


def sizes(spark, lake):
    return tuple(spark.table(lake.name(t)).count() for t in ("staging", "trusted", "quarantine"))


GOOD = [trip(i) for i in range(98)] + [trip(0)]
BAD = [trip(200, vendor=0), trip(201, amount=-1.0)]


def test_load_and_rerun(spark, lake):
    fill(spark, lake, GOOD + BAD)
    result = load_trusted(spark, job(lake))
    assert sizes(spark, lake) == (0, 99, 2)
    assert result.metrics.first()[n.TOTAL_ROWS] == 101
    assert [g.passed for g in result.gates.collect()] == [True, True]
    assert result.summary.first().asDict() == {
        "registros_quarentena": 2, "erros_tipagem": 0, "erros_logica_negocio": 0
    }
    assert spark.table(n.METRICS_VIEW).first()[n.TOTAL_ERRORS] == 2
    assert spark.table(n.FLAGGED_VIEW).count() == 0
    # The coded quarantine key holds the moment of the run: a rerun appends.
    load_trusted(spark, job(lake, LATER))
    assert sizes(spark, lake) == (0, 99, 4)


def test_documented_pack_reruns_without_growth(spark, lake):
    fill(spark, lake, GOOD + BAD + [trip(300, vendor=None)])
    for limits in (AT, LATER):
        load_trusted(spark, job(lake, limits, "documented", null_safe=True, dedupe_source=True))
        assert sizes(spark, lake) == (0, 98, 3)
    reasons = {r[n.REASONS] for r in spark.table(lake.name("quarantine")).collect()}
    assert reasons == {"VENDOR_ID_FORA_RANGE", "TOTAL_AMOUNT_FORA_RANGE", "VENDOR_ID_NULO"}


def test_a_failed_gate_writes_nothing_and_keeps_the_staged_rows(spark, lake):
    fill(spark, lake, GOOD + BAD * 4)
    with pytest.raises(gates.GateError, match="error_rate"):
        load_trusted(spark, job(lake))
    assert sizes(spark, lake) == (107, 0, 0)
    # The next run finds them staged already, and judges them again.
    load_trusted(spark, job(lake, max_pct_error="8.0"))
    assert sizes(spark, lake) == (0, 99, 8)


def test_a_value_that_does_not_fit_is_quarantined_as_a_type_error(spark, lake):
    fill(spark, lake, GOOD + [trip(500, vendor=2**40)])
    with pytest.raises(gates.GateError, match="type_rate"):
        load_trusted(spark, job(lake, null_safe=True))
    # Without null_safe the row, whose key is NULL now, would be staged a second time.
    result = load_trusted(spark, job(lake, null_safe=True, max_pct_type="1.0"))
    assert result.summary.first().erros_tipagem == 1 and sizes(spark, lake) == (0, 99, 1)


def test_an_empty_batch_fails(spark, lake):
    fill(spark, lake, [trip(0, month=4)])
    with pytest.raises(gates.GateError, match="nothing was measured"):
        load_trusted(spark, job(lake))


def test_the_newest_load_day_is_taken_over_the_whole_table(spark, lake):
    fill(spark, lake, [trip(0), trip(1, month=4, loaded=date(2023, 6, 2))])
    assert stage(spark.table(lake.name("raw")), "2023-05", "2023-05").count() == 0
    assert stage(spark.table(lake.name("raw")), "2023-04", "2023-05").count() == 1


def test_plain_sql_over_the_trusted_table_equals_the_rollup(spark, lake):
    fill(spark, lake, GOOD + BAD)
    load_trusted(spark, job(lake))
    by_sql = spark.sql(
        """SELECT year(tpep_pickup_datetime) AS ano, month(tpep_pickup_datetime) AS mes,
                  round(avg(total_amount), 2) AS media_valor_total, count(*) AS total_corridas
           FROM IDENTIFIER(:t) WHERE total_amount > 0 AND year(tpep_pickup_datetime) = :y
           GROUP BY ALL ORDER BY ano, mes""",
        {"t": lake.name("trusted"), "y": 2023},
    )
    columns = ["ano", "mes", "media_valor_total", "total_corridas"]
    rollup = rollups.monthly_amount(spark.table(lake.name("trusted")), 2023, columns=columns)
    assert by_sql.collect() == rollup.collect() != []


def test_limits_starting_now_accept_a_trip_of_today(spark, lake):
    start = datetime.now(timezone.utc).replace(tzinfo=None) - timedelta(hours=1)
    now = start.date().replace(day=1)
    fill(spark, lake, [(1, start, start + timedelta(minutes=5), 1.0, 5.0, now, now)])
    month = now.strftime("%Y-%m")
    load_trusted(spark, job(lake, Limits.starting_now(), start=month, end=month))
    assert sizes(spark, lake) == (0, 1, 0)


def test_trusted_is_laid_out_by_pickup_month(spark, lake):
    fill(spark, lake, GOOD + [(1, datetime(2023, 4, 30, 23, 55), datetime(2023, 5, 1, 0, 10), 1.0, 9.0,
                              date(2023, 5, 1), date(2023, 6, 1))])
    load_trusted(spark, job(lake))
    stored = spark.table(lake.name("trusted"))
    assert {r[0] for r in stored.select(n.PICKUP_MONTH).distinct().collect()} == {date(2023, 4, 1), date(2023, 5, 1)}
    assert stored.where(F.trunc(n.PICKUP, "month") != F.col(n.PICKUP_MONTH)).count() == 0


TEXT = ("VendorID string, tpep_pickup_datetime string, tpep_dropoff_datetime string, passenger_count string, "
        "total_amount string")


def test_what_a_source_delivers_wrongly_is_a_type_error_at_the_end(spark, lake):
    base = work_folder(spark, "landing")
    good = [("1", f"2023-05-01 10:{i:02d}:00", f"2023-05-01 11:{i:02d}:00", "2", "20.5") for i in range(57)]
    bad = [("abc", *good[0][1:]), ("1", "soon", *good[1][2:]), (*good[2][:3], "two", "9.5")]
    spark.createDataFrame(good[3:] + bad, TEXT).write.parquet(month_path(base, 2023, 5))
    load_raw(spark, raw_job(lake, base, start="2023-05", end="2023-05", as_of="2023-06-01 12:00:00"))
    with pytest.raises(gates.GateError, match="type_rate"):
        load_trusted(spark, job(lake, max_pct_error="10"))
    result = load_trusted(spark, job(lake, null_safe=True, max_pct_error="10", max_pct_type="10"))
    assert result.summary.first().erros_tipagem == 3 and sizes(spark, lake) == (0, 54, 3)
    found = {(r[n.REASONS], r[n.ERROR_CLASS]) for r in spark.table(lake.name("quarantine")).collect()}
    assert found == {("TIPO_VENDOR_ID_INVALIDO", "ERRO_TIPAGEM"), ("TIPO_PICKUP_INVALIDO", "ERRO_TIPAGEM"),
                     ("TIPO_PASSENGER_INVALIDO", "ERRO_TIPAGEM")}


def test_the_ledger_gives_the_newest_load_day(spark, lake):
    base = work_folder(spark, "landing")
    for month in (1, 2):
        land(spark, base, month, [1, 2])
    name = raw_job(lake, base).table
    days = [("2023-01", "2023-06-02 12:00:00"), ("2023-02", "2023-06-05 12:00:00"), ("2023-02", "2023-06-03 12:00:00")]
    for month, as_of in days:
        load_raw(spark, raw_job(lake, base, start=month, end=month, as_of=as_of))
        assert newest_load(spark, name, n.MONTH) == spark.table(name).agg(F.max(n.LOADED)).first()[0]
    # A month that came another way is not in the ledger: the table is asked.
    append(conform_raw(spark.createDataFrame([trip(0)], TRIP)), name)
    assert newest_load(spark, name, n.MONTH) is None


def test_loads_read_moments_as_utc_in_any_session(spark, lake):
    base = work_folder(spark, "landing")
    land(spark, base, 1, [1, 2], LANDED.replace("Airport_Fee", "total_amount"))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        load_raw(spark, raw_job(lake, base, end="2023-01", as_of="2023-01-06 02:00:00"))
        # The trips begin at 08:00 UTC of the 5th; an hour later they lie in the past.
        limits = Limits("2023-01-05 09:00:00")
        load_trusted(spark, job(lake, limits, start="2023-01", end="2023-01"))
        with pytest.raises(ValueError, match="future"):
            load_raw(spark, raw_job(lake, base, end="2023-02", as_of="2023-01-06 02:00:00"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sizes(spark, lake) == (0, 2, 0)
    assert {r[n.LOADED] for r in spark.table(lake.name("raw")).collect()} == {date(2023, 1, 5)}
