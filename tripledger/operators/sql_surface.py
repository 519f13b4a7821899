"""The rules for callers who write SQL: session variables for the limits, functions for flags, reasons, class and reports.

``register`` declares them in a session. They are SQL functions, which Spark expands into the caller's plan: nothing
leaves whole-stage code, columns are pruned and filters pushed as if the expressions had been written out.

    SELECT f.*, trip_reasons(f.flags), trip_class(f.flags) FROM flagged_trips() f WHERE f.tem_erro = 1
    SET VARIABLE trip_max_seconds = 7200
    SELECT * FROM trip_report()

A later ``SET VARIABLE`` changes the limits of every later statement.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tripledger import names as n
from tripledger.operators.rules import CORE_TYPES, TYPE_FLAGS, Limits, Rule, rules_of

VENDOR_OUTSIDE = "vendor NOT BETWEEN trip_vendor_least AND trip_vendor_most"
PASSENGERS_OUTSIDE = "passengers < 0 OR passengers > trip_passengers_most"
AMOUNT_OUTSIDE = "amount <= 0 OR amount > trip_amount_most"
SECONDS = "(CAST(dropoff AS BIGINT) - CAST(pickup AS BIGINT))"
OLDEST = "CAST(date_sub(to_date(trip_as_of), trip_age_days) AS TIMESTAMP)"

#: Function arguments that hold the core columns, in the order of ``CORE_TYPES``.
ARGUMENTS = dict(zip(CORE_TYPES, ("vendor", "pickup", "dropoff", "passengers", "amount"), strict=True))
LOGIC_CHECKS = {
    "falha_dropoff_antes_pickup": "dropoff <= pickup",
    "falha_duracao_excessiva": f"{SECONDS} > trip_max_seconds",
    "falha_duracao_muito_curta": f"{SECONDS} < trip_min_seconds",
    "falha_pickup_futuro": "pickup > trip_as_of",
    "falha_pickup_muito_antigo": f"pickup < {OLDEST}",
}


def _checks(pack: str) -> dict[str, str]:
    """Flag to SQL condition over the arguments; ``lost[k]`` is 1 if the k-th core value did not fit its type."""
    lost = {flag: f"lost[{k}] = 1" for k, flag in enumerate(TYPE_FLAGS.values())}
    absent = {
        c: f"{a} IS NULL AND lost[{k}] = 0" for k, (c, a) in enumerate(ARGUMENTS.items())
    }
    documented = pack == "documented"
    return lost | LOGIC_CHECKS | {
        "falha_vendor_id_nulo": absent[n.VENDOR],
        "falha_pickup_nulo": absent[n.PICKUP],
        "falha_dropoff_nulo": absent[n.DROPOFF] if documented else "false",
        "falha_passenger_count_nulo": absent[n.PASSENGERS],
        "falha_total_amount_nulo": absent[n.AMOUNT],
        "falha_vendor_id_invalido": VENDOR_OUTSIDE if documented else "vendor < 0",
        "falha_passenger_count_invalido": PASSENGERS_OUTSIDE if documented else "passengers < 0",
        "falha_total_amount_invalido": AMOUNT_OUTSIDE,
    }


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def _verdict() -> str:
    unusable = [f"{a} IS NULL" for a in ARGUMENTS.values()]
    checks = [VENDOR_OUTSIDE, PASSENGERS_OUTSIDE, AMOUNT_OUTSIDE, *LOGIC_CHECKS.values()]
    return _flag(" OR ".join(f"({c})" for c in unusable + checks))


def _class(rules: list[Rule]) -> str:
    raised = {
        name: " OR ".join(f"flags.{r.flag} = 1" for r in rules if r.error_class == name)
        for name in (n.CLASS_TYPE, n.CLASS_NULL, n.CLASS_LOGIC)
    }
    cases = " ".join(f"WHEN {condition} THEN '{name}'" for name, condition in raised.items())
    return f"CASE {cases} ELSE '{n.CLASS_RANGE}' END"


def declare_limits(spark: SparkSession, limits: Limits) -> None:
    """The limits as session variables, which SQL may change."""
    values = {
        "trip_as_of": ("TIMESTAMP", f"TIMESTAMP '{limits.as_of}'"),
        "trip_age_days": ("INT", limits.max_age_days),
        "trip_vendor_least": ("INT", limits.vendors[0]),
        "trip_vendor_most": ("INT", limits.vendors[1]),
        "trip_passengers_most": ("INT", limits.passengers_max),
        "trip_amount_most": ("DOUBLE", f"CAST('{limits.amount_max}' AS DOUBLE)"),
        "trip_min_seconds": ("BIGINT", limits.min_seconds),
        "trip_max_seconds": ("BIGINT", limits.max_seconds),
    }
    for name, (kind, value) in values.items():
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind} DEFAULT {value}")


def register(spark: SparkSession, source: str, limits: Limits, pack: str = "coded") -> None:
    """Declares, for the session, ``trip_flags``, ``trip_reasons``, ``trip_class`` (scalar), ``flagged_trips`` and ``trip_report`` (tables).

    ``source`` names a table or view with the core columns, typed or as text; type flags recorded in it count, as in
    ``rules.with_rules``. ``flagged_trips`` has its other columns, the struct ``flags``, the flags and the verdict.
    """
    rules, columns = rules_of(pack), spark.table(source).columns
    declare_limits(spark, limits)
    checks = _checks(pack)
    flags_type = f"STRUCT<{', '.join(f'{f}: INT' for f in [*(r.flag for r in rules), n.VERDICT])}>"
    members = ", ".join(f"'{r.flag}', {_flag(checks[r.flag])}" for r in rules)
    arguments = ", ".join(f"{a} {CORE_TYPES[c].upper()}" for c, a in ARGUMENTS.items())
    create = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(
        f"{create} trip_flags({arguments}, lost ARRAY<INT>) RETURNS {flags_type} "
        f"RETURN named_struct({members}, '{n.VERDICT}', {_verdict()})"
    )
    labels = ", ".join(f"CASE WHEN flags.{r.flag} = 1 THEN '{r.label}' END" for r in rules)
    spark.sql(f"{create} trip_reasons(flags {flags_type}) RETURNS STRING RETURN concat_ws('{n.REASON_SEPARATOR}', {labels})")
    spark.sql(f"{create} trip_class(flags {flags_type}) RETURNS STRING RETURN {_class(rules)}")

    values = ", ".join(f"try_cast(`{c}` AS {kind})" for c, kind in CORE_TYPES.items())
    lost = ", ".join(
        f"`{flag}`" if flag in columns else _flag(f"`{c}` IS NOT NULL AND try_cast(`{c}` AS {CORE_TYPES[c]}) IS NULL")
        for c, flag in TYPE_FLAGS.items()
    )
    kept = ", ".join(f"`{c}`" for c in columns if c not in TYPE_FLAGS.values())
    types = {f.name: f.dataType.simpleString() for f in spark.table(source).schema}
    shape = [f"`{c}` {types[c]}" for c in columns if c not in TYPE_FLAGS.values()]
    shape += [f"flags {flags_type}", *(f"{f} INT" for f in [*(r.flag for r in rules), n.VERDICT])]
    spark.sql(
        f"{create} flagged_trips() RETURNS TABLE ({', '.join(shape)}) RETURN "
        f"SELECT {kept}, flags, flags.* FROM (SELECT *, trip_flags({values}, array({lost})) AS flags FROM {source})"
    )
    sums = ", ".join(f"sum({r.flag}) AS {r.flag}" for r in rules)
    lines = ", ".join(f"named_struct('section', '{r.report}', 'rule', '{r.report_name}', 'rows', {r.flag})" for r in rules)
    spark.sql(
        f"{create} trip_report() RETURNS TABLE (section STRING, rule STRING, rows BIGINT) RETURN "
        f"SELECT inline(array({lines})) FROM (SELECT {sums} FROM flagged_trips())"
    )
