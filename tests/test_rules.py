from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tripledger import names as n
from tripledger.operators.metrics import quality_metrics
from tripledger.operators.rules import CODED, Limits, quarantine_rows, rules_of, valid_rows, with_rules
from tripledger.operators.staging import project_core

LIMITS = Limits("2023-06-01 12:00:00")
T0 = datetime(2023, 5, 1, 10, 0, 0)
GOOD = dict(vendor=1, pickup=T0, dropoff=T0 + timedelta(minutes=10), pax=2.0, amount=20.0)
SCHEMA = ("VendorID long, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
          "passenger_count double, total_amount double, date_reference date, insertion_date date")
LABEL = {r.flag: r.label for r in rules_of("documented")}


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def judge(spark, *changes, pack="coded", limits=LIMITS):
    """One flagged row per change to a good trip; the load day tells the rows apart."""
    rows = []
    for i, change in enumerate(changes):
        r = {**GOOD, **change}
        rows.append((r["vendor"], r["pickup"], r["dropoff"], r["pax"], r["amount"], date(2023, 5, 1),
                     date(2023, 6, 1) + timedelta(days=i)))
    raw = spark.createDataFrame(rows, SCHEMA).select(
        *[F.col(c).cast("timestamp") if c in (n.PICKUP, n.DROPOFF) else F.col(c) for c in SCHEMA_NAMES]
    )
    return with_rules(project_core(raw, "flag"), limits, pack)


def outcomes(spark, changes, pack):
    """Per change: (verdict, raised flags, reasons, class); the last two None for a valid row."""
    flagged = judge(spark, *changes, pack=pack)
    held = {r[n.LOADED]: r for r in quarantine_rows(flagged, LIMITS, pack).collect()}
    found = []
    for row in flagged.orderBy(n.LOADED).collect():
        raised = [r.flag for r in rules_of(pack) if row[r.flag] == 1]
        rejected = held.get(row[n.LOADED])
        found.append((row[n.VERDICT], raised, rejected and rejected[n.REASONS], rejected and rejected[n.ERROR_CLASS]))
    return found


def seconds(s):
    return dict(dropoff=T0 + timedelta(seconds=s))


GOOD_CASES = [
    {}, dict(vendor=4), dict(pax=0.0), dict(pax=9.0), dict(pax=9.9), dict(pax=-0.9), dict(amount=0.01),
    dict(amount=1000.0), seconds(60), seconds(86400), seconds(86400.9),
    dict(pickup=datetime(2023, 6, 1, 12), dropoff=datetime(2023, 6, 1, 12, 5)),
    dict(pickup=datetime(2013, 6, 3), dropoff=datetime(2013, 6, 3, 0, 5)),
]


@pytest.mark.parametrize("pack", ["coded", "documented"])
def test_rows_on_the_good_side_of_each_limit(spark, pack):
    assert outcomes(spark, GOOD_CASES, pack) == [(0, [], None, None)] * len(GOOD_CASES)


CODED_CASES = [
    (dict(vendor=None), ["falha_vendor_id_nulo"], n.CLASS_NULL),
    (dict(pickup=None), ["falha_pickup_nulo"], n.CLASS_NULL),
    (dict(dropoff=None), [], n.CLASS_RANGE),
    (dict(pax=None), ["falha_passenger_count_nulo"], n.CLASS_NULL),
    (dict(amount=None), ["falha_total_amount_nulo"], n.CLASS_NULL),
    (dict(vendor=0), [], n.CLASS_RANGE),
    (dict(vendor=5), [], n.CLASS_RANGE),
    (dict(vendor=-1), ["falha_vendor_id_invalido"], n.CLASS_RANGE),
    (dict(pax=-1.0), ["falha_passenger_count_invalido"], n.CLASS_RANGE),
    (dict(pax=10.0), [], n.CLASS_RANGE),
    (dict(amount=0.0), [], n.CLASS_RANGE),
    (dict(amount=1000.01), [], n.CLASS_RANGE),
    (seconds(59), ["falha_duracao_muito_curta"], n.CLASS_LOGIC),
    (seconds(59.9), ["falha_duracao_muito_curta"], n.CLASS_LOGIC),
    (seconds(0), ["falha_dropoff_antes_pickup", "falha_duracao_muito_curta"], n.CLASS_LOGIC),
    (seconds(-300), ["falha_dropoff_antes_pickup", "falha_duracao_muito_curta"], n.CLASS_LOGIC),
    (seconds(86401), ["falha_duracao_excessiva"], n.CLASS_LOGIC),
    (dict(pickup=datetime(2023, 6, 1, 12, 0, 1), dropoff=datetime(2023, 6, 1, 13)), ["falha_pickup_futuro"],
     n.CLASS_RANGE),
    (dict(pickup=datetime(2013, 6, 2, 23, 59, 59), dropoff=datetime(2013, 6, 3, 1)), ["falha_pickup_muito_antigo"],
     n.CLASS_RANGE),
    (dict(vendor=None, pax=-1.0), ["falha_vendor_id_nulo", "falha_passenger_count_invalido"], n.CLASS_NULL),
    (dict(pax=float("nan")), ["falha_tipo_passenger_count"], n.CLASS_TYPE),
    (dict(vendor=2**40), ["falha_tipo_vendor_id"], n.CLASS_TYPE),
    (dict(vendor=2**40, pickup=None), ["falha_tipo_vendor_id", "falha_pickup_nulo"], n.CLASS_TYPE),
    (dict(amount=float("nan")), [], n.CLASS_RANGE),
]
DOCUMENTED_CHANGES = {
    "dropoff": ["falha_dropoff_nulo"],
    "vendor": ["falha_vendor_id_invalido"],
    "pax": ["falha_passenger_count_invalido"],
    "amount": ["falha_total_amount_invalido"],
}


def test_coded_pack(spark):
    wanted = [(1, flags, " | ".join(LABEL[f] for f in flags), kind) for _, flags, kind in CODED_CASES]
    assert outcomes(spark, [c[0] for c in CODED_CASES], "coded") == wanted


def test_documented_pack_gives_every_rejected_row_a_reason(spark):
    wanted = []
    for change, flags, kind in CODED_CASES:
        flags = flags or DOCUMENTED_CHANGES[next(iter(change))]
        kind = n.CLASS_NULL if flags == ["falha_dropoff_nulo"] else kind
        wanted.append((1, flags, " | ".join(LABEL[f] for f in flags), kind))
    assert outcomes(spark, [c[0] for c in CODED_CASES], "documented") == wanted


def test_packs_have_17_and_18_flags_in_order():
    assert len(CODED) == 17 and len(rules_of("documented")) == 18
    coded = [r.flag for r in CODED]
    assert [r.flag for r in rules_of("documented") if r.flag in coded] == coded
    with pytest.raises(ValueError):
        rules_of("other")


def test_shapes_of_valid_and_quarantine(spark):
    flagged = judge(spark, {}, dict(vendor=9))
    valid, held = valid_rows(flagged), quarantine_rows(flagged, LIMITS)
    assert valid.dtypes == [("vendor_id", "bigint"), ("tpep_pickup_datetime", "timestamp"),
                            ("tpep_dropoff_datetime", "timestamp"), ("passenger_count", "int"),
                            ("total_amount", "double")]
    assert len(held.columns) == 29 and len(quarantine_rows(judge(spark, {}, pack="documented"), LIMITS,
                                                           "documented").columns) == 30
    assert valid.count() == held.count() == 1
    row = held.first()
    assert row[n.STAMP] == datetime(2023, 6, 1, 12) and row[n.QUARANTINE_DAY] == date(2023, 6, 1)


def test_text_is_judged_before_it_is_cast(spark):
    raw = spark.createDataFrame(
        [("abc", "soon", "later", "two", "x"), ("1", "2023-05-01 10:00:00", "2023-05-01 10:10:00", "1.9", "5")],
        "VendorID string, tpep_pickup_datetime string, tpep_dropoff_datetime string, "
        "passenger_count string, total_amount string",
    )
    flagged = with_rules(project_core(raw, "flag"), LIMITS)
    bad, good = flagged.collect()
    assert [bad[r.flag] for r in CODED[:10]] == [1] * 5 + [0] * 5
    assert bad[n.VERDICT] == 1 and good[n.VERDICT] == 0 and good[n.PASSENGERS] == 1
    metrics = quality_metrics(flagged).first()
    assert str(metrics[n.PCT_TYPE]) == "250.00"


def test_flags_are_never_null(spark):
    flagged = judge(spark, *[case[0] for case in CODED_CASES])
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in [r.flag for r in CODED] + [n.VERDICT]]
    assert set(flagged.agg(*nulls).first()) == {0}


def test_text_is_parsed_once_for_all_rules(spark):
    texts = [("1", "2001-05-01 00:00:00", "2001-05-01 00:30:00", "2.0", "9.5"), ("x", "soon", None, "two", ""),
             (None, "2001-05-01 00:00:00", "2001-04-30 00:00:00", "1.9", "-3")]
    raw = spark.createDataFrame(texts, ", ".join(f"{c} string" for c in n.CORE)).withColumn(n.MONTH, F.lit("2001-05-01").cast("date"))
    limits = Limits("2001-12-01 00:00:00")
    sources = {n.VENDOR: n.VENDOR}
    rows, once = (quarantine_rows(with_rules(project_core(raw, "flag", sources, once=x), limits), limits) for x in (False, True))
    assert rows.columns == once.columns and sorted(map(str, rows.collect())) == sorted(map(str, once.collect()))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    casts = [plan.count(f"try_cast({c}#") for c in (n.VENDOR, n.PICKUP, n.DROPOFF, n.AMOUNT)]
    assert casts == [1, 1, 1, 1]
