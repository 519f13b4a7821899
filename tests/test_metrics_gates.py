from decimal import Decimal

import pytest

from tripledger import names as n
from tripledger.operators import gates, metrics
from tripledger.operators.rules import CODED

FLAGS = [r.flag for r in CODED]


def flagged(spark, rows, errors, type_errors=0):
    """``rows`` rows, the first ``errors`` in error, the first ``type_errors`` with a type flag."""
    df = spark.range(rows)
    cases = [f"CAST(id < {type_errors} AS INT) AS {FLAGS[0]}"] + [f"0 AS {f}" for f in FLAGS[1:]]
    return df.selectExpr(*cases, f"CAST(id < {errors} AS INT) AS {n.VERDICT}")


def test_totals_and_percentages(spark):
    row = metrics.quality_metrics(flagged(spark, 800, 1, 1)).first()
    assert (row[n.TOTAL_ROWS], row[n.TOTAL_ERRORS], row[n.TOTAL_VALID]) == (800, 1, 799)
    # 0.125 and 99.875 both round half up.
    assert (row[n.PCT_ERROR], row[n.PCT_VALID]) == (Decimal("0.13"), Decimal("99.88"))


def test_empty_input_gives_nulls_and_fails_the_gates(spark):
    measured = metrics.quality_metrics(flagged(spark, 0, 0))
    row = measured.first()
    assert row[n.TOTAL_ROWS] == 0 and row[n.TOTAL_ERRORS] is None and row[n.PCT_ERROR] is None
    assert not gates.gate_error_rate(measured).first().passed
    with pytest.raises(gates.GateError, match="type_rate: nothing was measured"):
        gates.enforce(gates.gate_type_rate(measured))


@pytest.mark.parametrize("rows, errors, passed", [(100, 5, True), (100, 6, False), (20000, 1000, True),
                                                  (20000, 1001, False), (100000, 5004, True), (100000, 5005, False)])
def test_error_gate_compares_the_rounded_value(spark, rows, errors, passed):
    gate = gates.gate_error_rate(metrics.quality_metrics(flagged(spark, rows, errors)))
    assert gate.first().passed is passed
    if passed:
        gates.enforce(gate)
    else:
        with pytest.raises(gates.GateError, match=f"{errors} rows in error"):
            gates.enforce(gate)


@pytest.mark.parametrize("errors, passed", [(104, True), (105, False)])
def test_type_gate(spark, errors, passed):
    gate = gates.gate_type_rate(metrics.quality_metrics(flagged(spark, 100000, errors, errors)))
    assert gate.first().passed is passed


def test_thresholds_are_parameters(spark):
    measured = metrics.quality_metrics(flagged(spark, 100, 6))
    assert gates.gate_error_rate(measured, "6.0").first().passed
    assert not gates.gate_error_rate(measured, "5.99").first().passed


@pytest.mark.parametrize("limit, passed", [("0.1", False), ("0.13", True), ("0.125", False), ("0.130", True), ("1", True)])
def test_limits_keep_their_places(spark, limit, passed):
    gate = gates.gate_error_rate(metrics.quality_metrics(flagged(spark, 800, 1)), limit).first()
    assert gate.observed == Decimal("0.13") and gate.threshold == Decimal(limit) and gate.passed is passed


def test_reports(spark):
    measured = metrics.quality_metrics(flagged(spark, 200, 3, 1))
    summary = metrics.report_summary(measured).first()
    assert (summary.total_processado, summary.aprovados, summary.reprovados) == (200, 197, 3)
    assert (summary.taxa_aprovacao, summary.taxa_erro) == ("98.50%", "1.50%")
    types = metrics.report_types(measured).first()
    assert types.vendor_id_tipo_invalido == 1 and types.percentual_erro_tipo == "0.50%"
    assert metrics.report_ranges(measured).columns == ["vendor_fora_range", "passenger_fora_range"]
    assert metrics.report_long(measured).count() == 17


def test_metrics_need_one_exchange(spark):
    plan = metrics.quality_metrics(flagged(spark, 100, 6))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
