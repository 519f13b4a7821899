"""One registered query per operator, over the supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, TimestampType

from tripledger import names as n
from tripledger.checks.scratch import lake
from tripledger.functions import months
from tripledger.functions.columns import whole_seconds
from tripledger.operators import conform as cf
from tripledger.operators import gates, kept, metrics, rollups, sql_surface
from tripledger.operators.merge import insert_only_merge
from tripledger.operators.publish import publish, sweep, write_run
from tripledger.operators.rules import (
    CODED,
    TYPE,
    Limits,
    quarantine_rows,
    rules_of,
    valid_rows,
    with_rules,
)
from tripledger.operators.staging import latest_load, project_core, stage, with_pickup_month
from tripledger.operators.writers import (
    append,
    arrange,
    export_csv,
    export_parquet,
    read_csv,
    replace_month_files,
    replace_partitions,
    truncate,
)
from tripledger.plans.raw_load import RawLoad, conform_raw, load_raw
from tripledger.plans.trusted_load import STAGING_KEYS, TrustedLoad, load_trusted, write_quarantine
from tripledger.session import apply_settings, work_folder
from tripledger.sources import contracts, landing, tables
from tripledger.sources.fixtures import supplied, trips, trips_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Two fixed moments: with the first the batch passes its gates, with the second it does not.
PASSING = Limits("2001-12-01 00:00:00", 3650)
FAILING = Limits("2001-07-01 00:00:00", 2190)
START, END = "1997-01", "1997-05"
BUCKETS = 4
LANDED_AS = "month={year}-{month:02d}"
LANDED_PATTERN = r"/month=([0-9]{4}-(?:0[1-9]|1[0-2]))/"
TEXT_SOURCES = {
    n.VENDOR: "vendor_txt",
    n.PICKUP: "pickup_txt",
    n.DROPOFF: "dropoff_txt",
    n.PASSENGERS: "passengers_txt",
    n.AMOUNT: "amount_txt",
}


def comparable(df: DataFrame) -> DataFrame:
    """Types that look alike in any engine: dates as text, decimals as double, no time zones."""
    plain = []
    for f in df.schema:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DateType):
            column = column.cast("string")
        elif isinstance(f.dataType, TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(f.dataType, DecimalType):
            column = column.cast("double")
        plain.append(column.alias(f.name))
    return df.select(plain)


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(build(apply_settings(spark), sf_dir))

        QUERIES[name] = run
        return build

    return register


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_core(trips(spark, sf_dir))


def core_of_text(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    return project_core(trips_text(trips(spark, sf_dir)), "flag", TEXT_SOURCES, once)


def flagged(spark: SparkSession, sf_dir: str, limits: Limits = PASSING, pack: str = "coded") -> DataFrame:
    return with_rules(core(spark, sf_dir), limits, pack)


def rejected(spark: SparkSession, sf_dir: str, limits: Limits = PASSING, pack: str = "coded") -> DataFrame:
    return quarantine_rows(flagged(spark, sf_dir, limits, pack), limits, pack)


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(flagged(spark, sf_dir))


def land(spark: SparkSession, sf_dir: str) -> str:
    """All trips as monthly landing files, written in one job."""
    base = work_folder(spark, "landing")
    rows = trips(spark, sf_dir).withColumn("month", F.date_format(n.MONTH, "yyyy-MM"))
    arrange(rows, ("month",)).write.mode("overwrite").partitionBy("month").parquet(base)
    return base


# --- sources and tables -----------------------------------------------------------
@query("scan_month")
def _(spark, sf_dir):
    return landing.scan_month(spark, land(spark, sf_dir), 1997, 3, LANDED_AS)


@query("landing_gaps")
def _(spark, sf_dir):
    ordered = supplied(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    seen = supplied(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"))
    spine = months.observed_spine(ordered.unionByName(seen), "day")
    return landing.landing_gaps(spine, landing.landed_months(spark, land(spark, sf_dir), LANDED_PATTERN))


@query("catalog_setup")
def _(spark, sf_dir):
    with lake(spark) as place:
        append(conform_raw(trips(spark, sf_dir)), place.raw())
        return place.files("raw").groupBy(n.MONTH).agg(F.count("*").alias("rows"))


@query("catalog_listing")
def _(spark, sf_dir):
    """The listed schema with its comment, and the rows its tables hold."""
    with lake(spark) as place:
        append(conform_raw(trips(spark, sf_dir)), place.raw())
        append(with_pickup_month(trusted(spark, sf_dir)), place.trusted())
        listed = tables.schemas(spark).where(F.col("schema") == place.schema)
        listed = spark.createDataFrame(listed.collect(), listed.schema)
        sizes = [place.files(t).agg(F.lit(t).alias("table_name"), F.count("*").alias("rows")) for t in ("raw", "trusted")]
        return listed.select("catalog", "comment").join(sizes[0].unionByName(sizes[1]))


@query("describe_contract")
def _(spark, sf_dir):
    """Columns of all four tables as the catalog tells them, with how many values each holds."""
    with lake(spark) as place:
        found = []
        for name in _fill_all(spark, sf_dir, place):
            told = [(name, r[0], r[1], int(bool(r[2]))) for r in tables.column_detail(spark, place.name(name)).collect()]
            described = spark.createDataFrame(
                told, "table_name string, column_name string, data_type string, has_comment int"
            )
            filled = cf.schema_report(place.files(name), place.files(name).schema).drop("state")
            found.append(described.join(F.broadcast(filled), "column_name"))
        return reduce(DataFrame.unionByName, found)


def _fill_all(spark: SparkSession, sf_dir: str, place) -> list[str]:
    raw = conform_raw(trips(spark, sf_dir))
    append(raw, place.raw())
    append(with_pickup_month(project_core(raw, "flag")), place.staging())
    append(with_pickup_month(trusted(spark, sf_dir)), place.trusted())
    append(rejected(spark, sf_dir), place.quarantine())
    return ["raw", "staging", "trusted", "quarantine"]


@query("table_detail")
def _(spark, sf_dir):
    with lake(spark) as place:
        _fill_all(spark, sf_dir, place)
        detail = tables.table_detail(spark, place.schema)
        lines = spark.createDataFrame(detail.collect(), detail.schema)
        counts = [
            place.files(t).agg(F.lit(t).alias("table_name"), F.count("*").alias("rows"))
            for t in ("raw", "staging", "trusted", "quarantine")
        ]
        counted = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
        return lines.join(counted, "table_name").select("table_name", "provider", "partitions", "rows")


# --- projections, parameters, filters ---------------------------------------------
@query("project_core")
def _(spark, sf_dir):
    return core(spark, sf_dir)


@query("project_core_flagged")
def _(spark, sf_dir):
    return core_of_text(spark, sf_dir)


@query("month_range_filter")
def _(spark, sf_dir):
    return trips(spark, sf_dir).where(months.in_month_range(n.MONTH, START, END))


@query("latest_load_filter")
def _(spark, sf_dir):
    raw = trips(spark, sf_dir)
    return raw.where(latest_load(raw))


@query("staged_batch")
def _(spark, sf_dir):
    return stage(trips(spark, sf_dir), START, END)


@query("positive_filter")
def _(spark, sf_dir):
    return core(spark, sf_dir).where(rollups.positive(n.AMOUNT) & rollups.positive(n.PASSENGERS))


@query("calendar_range_filter")
def _(spark, sf_dir):
    return core(spark, sf_dir).where(months.in_months_of_year(n.PICKUP, 1997, 1, 5))


@query("param_query")
def _(spark, sf_dir):
    trips(spark, sf_dir).createOrReplaceTempView("tripledger_trips")
    return spark.sql(
        """
        SELECT date_reference, count(*) AS rows, count(VendorID) AS vendors_filled
        FROM IDENTIFIER(:prefix || '_' || :table)
        WHERE date_reference BETWEEN CAST(concat(:start, '-01') AS DATE) AND CAST(concat(:end, '-01') AS DATE)
        GROUP BY date_reference
        """,
        {"prefix": "tripledger", "table": "trips", "start": START, "end": END},
    )


@query("month_format_filter")
def _(spark, sf_dir):
    months_given = trips_text(trips(spark, sf_dir)).select(F.substring("pickup_txt", 1, 7).alias("month_text"))
    return months_given.where(months.is_month_text("month_text")).groupBy("month_text").agg(
        F.count("*").alias("rows")
    )


@query("month_spine")
def _(spark, sf_dir):
    return months.observed_spine(trips(spark, sf_dir), n.MONTH)


# --- conformance ------------------------------------------------------------------
def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips as a careless source delivers them: spelling, types, order and columns differ."""
    typed = trips(spark, sf_dir)
    unreadable = F.col("tpep_pickup_datetime").cast("bigint") % 501 == 0
    return typed.select(
        F.col("total_amount").alias("Total_Amount"),
        F.when(unreadable, "abc").otherwise(F.col("VendorID").cast("string")).alias("vendorid"),
        F.lit("x").alias("unknown_column"),
        F.col("tpep_dropoff_datetime").cast("timestamp_ntz").alias("tpep_dropoff_datetime"),
        F.col("tpep_pickup_datetime").cast("timestamp_ntz").alias("tpep_pickup_datetime"),
        F.col("passenger_count").try_cast("int").alias("passenger_count"),
        "date_reference",
    )


@query("schema_diff")
def _(spark, sf_dir):
    return cf.schema_report(delivered(spark, sf_dir), contracts.raw_schema())


@query("normalize_names")
def _(spark, sf_dir):
    return cf.normalize_names(delivered(spark, sf_dir), contracts.raw_schema())


@query("add_missing")
def _(spark, sf_dir):
    return cf.add_missing(trips(spark, sf_dir), contracts.raw_schema())


@query("cast_contract")
def _(spark, sf_dir):
    named = cf.normalize_names(delivered(spark, sf_dir), contracts.raw_schema())
    return cf.cast_to(named, contracts.raw_schema())


@query("conform")
def _(spark, sf_dir):
    return cf.conform(delivered(spark, sf_dir), contracts.raw_schema())


@query("add_load_metadata")
def _(spark, sf_dir):
    given = trips(spark, sf_dir).drop(n.MONTH, n.LOADED)
    # One hour past midnight UTC is still the day before in the operator's zone.
    return landing.with_load_metadata(given, 1997, 3, "2001-12-01 01:00:00")


@query("non_empty_gate")
def _(spark, sf_dir):
    ordered = supplied(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    seen = supplied(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"))
    return gates.non_empty_gate(months.observed_spine(ordered.unionByName(seen), "day"), trips(spark, sf_dir), n.MONTH)


# --- row rules --------------------------------------------------------------------
def _flag_by_month(rows: DataFrame, flag: str) -> DataFrame:
    return rows.groupBy(n.MONTH).agg(F.count("*").alias("rows"), F.sum(flag).alias("flagged"))


def _rule_query(rule, pack: str) -> Query:
    def run(spark, sf_dir):
        source = core_of_text(spark, sf_dir) if rule.report == TYPE else core(spark, sf_dir)
        limits = FAILING if rule.flag in ("falha_pickup_futuro", "falha_pickup_muito_antigo") else PASSING
        return _flag_by_month(with_rules(source, limits, pack), rule.flag)

    return run


def rule_keys() -> dict[str, tuple]:
    """Key -> (rule, pack): every coded rule, and those the documented pack changes or adds."""
    coded = {r.flag: r for r in CODED}
    keys = {f"rule_{r.flag}": (r, "coded") for r in CODED}
    for r in rules_of("documented"):
        if r.flag not in coded or coded[r.flag].fails is not r.fails:
            keys[f"rule_{r.flag}_documented"] = (r, "documented")
    return keys


for _key, (_rule, _pack) in rule_keys().items():
    query(_key)(_rule_query(_rule, _pack))


@query("row_verdict")
def _(spark, sf_dir):
    return flagged(spark, sf_dir, FAILING).groupBy(n.MONTH, n.VERDICT).agg(F.count("*").alias("rows"))


@query("error_reasons")
def _(spark, sf_dir):
    return metrics.reason_patterns(rejected(spark, sf_dir, FAILING))


@query("error_reasons_documented")
def _(spark, sf_dir):
    return metrics.reason_patterns(rejected(spark, sf_dir, FAILING, "documented"))


@query("error_class")
def _(spark, sf_dir):
    rows = quarantine_rows(with_rules(core_of_text(spark, sf_dir, once=True), PASSING), PASSING)
    return rows.groupBy(n.ERROR_CLASS).agg(F.count("*").alias("rows"))


@query("error_class_documented")
def _(spark, sf_dir):
    rows = quarantine_rows(with_rules(core_of_text(spark, sf_dir, once=True), PASSING, "documented"), PASSING, "documented")
    return rows.groupBy(n.ERROR_CLASS).agg(F.count("*").alias("rows"))


@query("flagged_rows")
def _(spark, sf_dir):
    return flagged(spark, sf_dir, FAILING)


def in_sql(spark: SparkSession, rows: DataFrame, statement: str, pack: str = "coded") -> DataFrame:
    """A statement over the SQL functions of the rules, declared for these rows."""
    view = f"trips_{uuid.uuid4().hex[:12]}"
    rows.createOrReplaceTempView(view)
    sql_surface.register(spark, view, FAILING, pack)
    return spark.sql(statement)


@query("sql_flagged_rows")
def _(spark, sf_dir):
    return in_sql(spark, core(spark, sf_dir), "SELECT * EXCEPT (flags) FROM flagged_trips()")


@query("sql_report")
def _(spark, sf_dir):
    return in_sql(spark, core(spark, sf_dir), "SELECT * FROM trip_report()", "documented")


@query("quarantine_rows")
def _(spark, sf_dir):
    return rejected(spark, sf_dir)


@query("split_valid")
def _(spark, sf_dir):
    return trusted(spark, sf_dir)


@query("split_quarantine")
def _(spark, sf_dir):
    return flagged(spark, sf_dir).where(F.col(n.VERDICT) == 1)


# --- metrics, reports, gates ------------------------------------------------------
def measured(spark: SparkSession, sf_dir: str, limits: Limits = PASSING, pack: str = "coded") -> DataFrame:
    return metrics.quality_metrics(flagged(spark, sf_dir, limits, pack), pack)


def measured_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quality_metrics(with_rules(core_of_text(spark, sf_dir), PASSING))


@query("quality_metrics")
def _(spark, sf_dir):
    return measured(spark, sf_dir, FAILING)


@query("quality_metrics_documented")
def _(spark, sf_dir):
    return measured(spark, sf_dir, FAILING, "documented")


@query("quality_percentages")
def _(spark, sf_dir):
    return measured_text(spark, sf_dir).select(n.PCT_ERROR, n.PCT_VALID, n.PCT_TYPE)


@query("report_summary")
def _(spark, sf_dir):
    return metrics.report_summary(measured(spark, sf_dir))


@query("report_types")
def _(spark, sf_dir):
    return metrics.report_types(measured_text(spark, sf_dir))


@query("report_nulls")
def _(spark, sf_dir):
    return metrics.report_nulls(measured(spark, sf_dir))


@query("report_ranges")
def _(spark, sf_dir):
    return metrics.report_ranges(measured(spark, sf_dir))


@query("report_logic")
def _(spark, sf_dir):
    return metrics.report_logic(measured(spark, sf_dir, FAILING))


@query("report_long")
def _(spark, sf_dir):
    return metrics.report_long(measured(spark, sf_dir, FAILING, "documented"), "documented")


@query("run_summary")
def _(spark, sf_dir):
    rows = quarantine_rows(with_rules(core_of_text(spark, sf_dir, once=True), PASSING), PASSING)
    return metrics.run_summary(rows, PASSING.today)


@query("quarantine_by_class")
def _(spark, sf_dir):
    return metrics.quarantine_by_class(rejected(spark, sf_dir, FAILING))


@query("gate_error_rate")
def _(spark, sf_dir):
    """Passed, failed, failed by the third place of its limit, and failed for want of rows."""
    nothing = metrics.quality_metrics(flagged(spark, sf_dir).where(F.lit(False)))
    found = gates.gate_error_rate(measured(spark, sf_dir))
    found = found.unionByName(gates.gate_error_rate(measured(spark, sf_dir, FAILING)))
    found = found.unionByName(gates.gate_error_rate(measured(spark, sf_dir, FAILING), "0.125"))
    return found.unionByName(gates.gate_error_rate(nothing))


@query("gate_type_rate")
def _(spark, sf_dir):
    found = gates.gate_type_rate(measured(spark, sf_dir))
    found = found.unionByName(gates.gate_type_rate(measured_text(spark, sf_dir)))
    return found.unionByName(gates.gate_type_rate(measured_text(spark, sf_dir), "0.875"))


# --- writers ----------------------------------------------------------------------
@query("layout_write")
def _(spark, sf_dir):
    path = work_folder(spark, "layout")
    for _ in range(2):
        replace_month_files(trips(spark, sf_dir), path, n.MONTH, ("VendorID",))
    return spark.read.schema(trips(spark, sf_dir).schema).parquet(path)


@query("replace_month")
def _(spark, sf_dir):
    rows = trips(spark, sf_dir)
    later = rows.where(months.in_month_range(n.MONTH, START, END)).withColumn("payment_type", F.lit(2))
    with lake(spark) as place:
        table = place.raw()
        for batch in (rows, later, later):
            conformed = conform_raw(batch)
            replace_partitions(arrange(conformed, (n.MONTH,), ("VendorID",)), table)
        return place.files("raw").select(*rows.columns, "payment_type")


@query("replace_month_published")
def _(spark, sf_dir):
    """The same months, each shown by a change of its catalog entry; a run that breaks before it is shown changes nothing."""
    rows = trips(spark, sf_dir)
    later = rows.where(months.in_month_range(n.MONTH, START, END)).withColumn("payment_type", F.lit(2))
    with lake(spark) as place:
        table = place.raw()
        for batch, ends in ((rows, True), (later, False), (later, True), (later, True)):
            run = write_run(arrange(conform_raw(batch), (n.MONTH,), ("VendorID",)), table)
            if ends:
                publish([run])
        sweep(spark, table)
        return place.shown("raw").select(*rows.columns, "payment_type")


@query("staging_lifecycle")
def _(spark, sf_dir):
    with lake(spark) as place:
        table = place.staging()
        append(with_pickup_month(project_core(trips(spark, sf_dir), "flag")), table)
        before = spark.table(table).count()
        truncate(spark, table)
        return place.files("staging").agg(F.lit(before).cast("bigint").alias("rows_before"),
                                          F.count("*").alias("rows_after"))


@query("export_csv")
def _(spark, sf_dir):
    """Trusted rows with microseconds and a text that plain CSV would change."""
    path = work_folder(spark, "csv")
    texts = {0: None, 1: "", 2: " a ", 3: 'say "x", y', 4: "two\nlines\\n", 5: "\\N"}
    note = F
    for passengers, text in texts.items():
        note = note.when(F.col(n.PASSENGERS) == passengers, F.lit(text).cast("string"))
    rows = trusted(spark, sf_dir).withColumns({
        n.PICKUP: F.timestamp_add("MICROSECOND", 123457 * F.col(n.PASSENGERS), F.col(n.PICKUP)),
        "note": note.otherwise("plain"),
    })
    export_csv(rows, path)
    return read_csv(spark, path, rows.schema)


@query("export_parquet")
def _(spark, sf_dir):
    path = work_folder(spark, "parquet")
    for _ in range(2):
        export_parquet(trusted(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("merge_staging")
def _(spark, sf_dir):
    batch = with_pickup_month(project_core(trips(spark, sf_dir)))
    with lake(spark) as place:
        table = place.staging()
        for _ in range(2):
            insert_only_merge(batch, table, STAGING_KEYS, prune_on=n.PICKUP_MONTH)
        return place.files("staging").select(*batch.drop(n.PICKUP_MONTH).columns)


def _merge_trusted(rows: DataFrame, **options) -> DataFrame:
    valid = with_pickup_month(rows)
    with lake(rows.sparkSession) as place:
        table = place.trusted()
        for _ in range(2):
            insert_only_merge(valid, table, n.CORE, layout=((n.PICKUP_MONTH,), (n.VENDOR,)), **options)
        return place.files("trusted").select(*n.CORE)


@query("merge_trusted")
def _(spark, sf_dir):
    """The second run finds every key stored and adds nothing; the keys meet in a join."""
    return _merge_trusted(trusted(spark, sf_dir), prune_on=n.PICKUP_MONTH)


@query("merge_trusted_bucketed")
def _(spark, sf_dir):
    """A table bucketed by vendor, pickup and dropoff: its keys meet the batch without a shuffle of their own."""
    valid = with_pickup_month(trusted(spark, sf_dir))
    with lake(spark) as place:
        table = place.trusted(buckets=BUCKETS)
        for _ in range(2):
            insert_only_merge(valid, table, n.CORE, prune_on=n.PICKUP_MONTH)
        return place.files("trusted").select(*n.CORE)


@query("merge_resume")
def _(spark, sf_dir):
    """An append broke after one copy of each row: the rerun adds the copies that are missing, a third run none."""
    valid = with_pickup_month(trusted(spark, sf_dir))
    with lake(spark) as place:
        table = place.trusted()
        append(arrange(valid.dropDuplicates(), (n.PICKUP_MONTH,)), table)
        for _ in range(2):
            insert_only_merge(valid, table, n.CORE, prune_on=n.PICKUP_MONTH, layout=((n.PICKUP_MONTH,), (n.VENDOR,)), resume=True)
        return place.files("trusted").select(*n.CORE)


@query("merge_trusted_lookup")
def _(spark, sf_dir):
    """The same batch without pruning: all stored keys meet it."""
    return _merge_trusted(trusted(spark, sf_dir))


@query("merge_trusted_hot_key")
def _(spark, sf_dir):
    """A third of the rows carries one and the same key."""
    night = F.hour(n.PICKUP) < 8
    same = {
        n.VENDOR: F.lit(2).cast("bigint"),
        n.PICKUP: F.lit("1997-03-01 00:00:00").cast("timestamp"),
        n.DROPOFF: F.lit("1997-03-01 00:30:00").cast("timestamp"),
        n.PASSENGERS: F.lit(1),
        n.AMOUNT: F.lit(20.5),
    }
    rows = trusted(spark, sf_dir).select([F.when(night, same[c]).otherwise(F.col(c)).alias(c) for c in n.CORE])
    return _merge_trusted(rows, prune_on=n.PICKUP_MONTH)


@query("merge_trusted_deduped")
def _(spark, sf_dir):
    return _merge_trusted(trusted(spark, sf_dir), dedupe_source=True, prune_on=n.PICKUP_MONTH)


def _quarantined(spark: SparkSession, sf_dir: str, pack: str, moments: tuple[Limits, ...]) -> DataFrame:
    """The stored quarantine rows after a write at each moment."""
    with lake(spark) as place:
        table = place.quarantine(pack)
        for limits in moments:
            job = TrustedLoad("", "", "", table, START, END, limits, pack)
            write_quarantine(rejected(spark, sf_dir, limits, pack), job)
        return place.files("quarantine")


@query("merge_quarantine")
def _(spark, sf_dir):
    """Two runs at two moments: the coded key holds the moment, so both are kept."""
    return _quarantined(spark, sf_dir, "coded", (PASSING, Limits("2001-12-02 00:00:00")))


@query("merge_quarantine_documented")
def _(spark, sf_dir):
    """The documented key leaves the moment out: a second run on the day adds nothing."""
    return _quarantined(spark, sf_dir, "documented", (PASSING, Limits("2001-12-01 08:00:00")))


@query("merge_evolve")
def _(spark, sf_dir):
    """A later batch brings a column the table lacks; earlier rows read NULL there."""
    first = trusted(spark, sf_dir).where(months.in_months_of_year(n.PICKUP, 1997, 1, 5))
    second = trusted(spark, sf_dir).withColumn("pickup_date", F.to_date(n.PICKUP))
    with lake(spark) as place:
        tables.create_table(spark, place.name("trips"), contracts.trusted_schema(), location=place.place("trips"))
        insert_only_merge(first, place.name("trips"), n.CORE)
        insert_only_merge(second, place.name("trips"), n.CORE, evolve=True)
        return place.files("trips")


@query("dedupe_exact")
def _(spark, sf_dir):
    return trips(spark, sf_dir).dropDuplicates()


@query("duplicate_keys")
def _(spark, sf_dir):
    return rollups.duplicate_keys(trusted(spark, sf_dir), n.CORE)


# --- rollups and profiles ---------------------------------------------------------
@query("monthly_amount")
def _(spark, sf_dir):
    return rollups.monthly_amount(trusted(spark, sf_dir), 1997, (1, 5))


@query("monthly_amount_all")
def _(spark, sf_dir):
    return rollups.monthly_amount(
        trusted(spark, sf_dir), columns=["ano", "mes", "media_valor_total", "total_corridas"]
    )


@query("monthly_amount_short")
def _(spark, sf_dir):
    return rollups.monthly_amount(
        trusted(spark, sf_dir), 1997, (1, 5), columns=["ano", "mes", "periodo", "media_valor_total"]
    )


@query("hourly_passengers")
def _(spark, sf_dir):
    return rollups.hourly_passengers(trusted(spark, sf_dir), 1997, 5)


@query("hourly_passengers_short")
def _(spark, sf_dir):
    return rollups.hourly_passengers(
        trusted(spark, sf_dir), 1997, 5, columns=["hora_do_dia", "media_passageiros", "total_corridas"]
    )


def kept_table(spark: SparkSession, sf_dir: str, place) -> DataFrame:
    """Partial aggregates kept over a trusted table that grows: the later months come after a first refresh."""
    rows = with_pickup_month(trusted(spark, sf_dir))
    table, late = place.trusted(), F.col(n.PICKUP_MONTH) >= "1997-03-01"
    kept.create_kept(spark, place.name("kept"), place.place("kept"))
    for some in (rows.where(~late), rows.where(late)):
        append(arrange(some, (n.PICKUP_MONTH,)), table)
        kept.refresh(spark, table, place.name("kept"))
    return place.files("kept")


@query("monthly_amount_kept")
def _(spark, sf_dir):
    with lake(spark) as place:
        return kept.monthly_amount(kept_table(spark, sf_dir, place), 1997, (1, 5))


@query("hourly_passengers_kept")
def _(spark, sf_dir):
    with lake(spark) as place:
        return kept.hourly_passengers(kept_table(spark, sf_dir, place), 1997, 5)


@query("profiles_kept")
def _(spark, sf_dir):
    with lake(spark) as place:
        rows = kept_table(spark, sf_dir, place)
        return kept.trusted_profile(rows).unionByName(kept.clean_profile(rows), allowMissingColumns=True)


@query("hourly_events")
def _(spark, sf_dir):
    """The same rollup over the supplied events: value per hour of January 2024."""
    seen = supplied(spark, sf_dir, "events").select(
        F.col("ts").alias(n.PICKUP), F.col("value").cast("int").alias(n.PASSENGERS)
    )
    return rollups.hourly_passengers(seen, 2024, 1, columns=["hora_do_dia", "media_passageiros", "total_corridas"])


@query("raw_count")
def _(spark, sf_dir):
    return rollups.row_count(trips(spark, sf_dir))


@query("trusted_profile")
def _(spark, sf_dir):
    return rollups.trusted_profile(trusted(spark, sf_dir))


@query("clean_profile")
def _(spark, sf_dir):
    return rollups.clean_profile(trusted(spark, sf_dir))


@query("coverage_profile")
def _(spark, sf_dir):
    return rollups.coverage_profile(trips(spark, sf_dir))


@query("trip_enrich")
def _(spark, sf_dir):
    return rollups.enrich(trusted(spark, sf_dir))


@query("scalar_functions")
def _(spark, sf_dir):
    pickup, dropoff = F.col(n.PICKUP), F.col(n.DROPOFF)
    return trips(spark, sf_dir).select(
        F.col("passenger_count").cast("int").alias("truncated"),
        F.col("VendorID").cast("string").try_cast("int").alias("tried"),
        F.when(F.col("VendorID") < 0, 1).otherwise(0).alias("cased"),
        months.month_label(n.PICKUP).alias("label"),
        F.concat_ws(n.REASON_SEPARATOR, F.when(pickup.isNull(), "P"), F.when(dropoff.isNull(), "D")).alias("joined"),
        F.year(pickup).alias("y"),
        F.month(pickup).alias("m"),
        F.hour(pickup).alias("hr"),
        F.round("total_amount", 2).alias("rounded"),
        F.to_date(pickup).alias("day"),
        F.date_sub(F.to_date(pickup), 3650).alias("ten_years_before"),
        whole_seconds(pickup, dropoff).alias("seconds"),
        F.to_date(F.concat(F.date_format(n.MONTH, "yyyy-MM"), F.lit("-01")), "yyyy-MM-dd").alias("parsed"),
        F.col("passenger_count").between(0, 9).cast("int").alias("seated"),
        (~F.col("VendorID").between(1, 4)).alias("outside"),
        F.expr("if(total_amount > 1000, 'high', NULL)").alias("band"),
        F.assert_true(F.col(n.MONTH).isNotNull(), "no month").cast("string").alias("asserted"),
    )


# --- whole loads ------------------------------------------------------------------
@query("raw_load")
def _(spark, sf_dir):
    base = land(spark, sf_dir)
    with lake(spark) as place:
        place.raw()
        for _ in range(2):
            load_raw(spark, RawLoad(base, place.name("raw"), START, END, "2001-12-01 12:00:00", LANDED_AS))
        return place.files("raw")


@query("trusted_load")
def _(spark, sf_dir):
    """Raw to trusted and quarantine, twice: trusted stays as it is, quarantine grows."""
    with lake(spark) as place:
        append(arrange(conform_raw(trips(spark, sf_dir)), (n.MONTH,)), place.raw())
        span = spark.table(place.name("raw")).agg(F.min(n.MONTH), F.max(n.MONTH)).first()
        job = TrustedLoad(place.name("raw"), place.staging(), place.trusted(), place.quarantine(),
                          f"{span[0]:%Y-%m}", f"{span[1]:%Y-%m}", PASSING)
        for _ in range(2):
            load_trusted(spark, job)
        kept, held = place.files("trusted").drop(n.PICKUP_MONTH), place.files("quarantine")
        return kept.unionByName(held, allowMissingColumns=True)


@query("trusted_load_published")
def _(spark, sf_dir):
    """The same two runs, each shown at its end by new catalog entries, over a bucketed trusted table."""
    with lake(spark) as place:
        append(arrange(conform_raw(trips(spark, sf_dir)), (n.MONTH,)), place.raw())
        span = spark.table(place.name("raw")).agg(F.min(n.MONTH), F.max(n.MONTH)).first()
        job = TrustedLoad(place.name("raw"), place.staging(), place.trusted(buckets=BUCKETS, by_run=True),
                          place.quarantine(by_run=True), f"{span[0]:%Y-%m}", f"{span[1]:%Y-%m}", PASSING, publish="pointer")
        for _ in range(2):
            load_trusted(spark, job)
        kept, held = place.shown("trusted").drop(n.PICKUP_MONTH, n.RUN), place.shown("quarantine").drop(n.RUN)
        return kept.unionByName(held, allowMissingColumns=True)


@query("load_text_types")
def _(spark, sf_dir):
    """Trips landed as text, with unreadable values: landing to quarantine, reasons and class as delivered."""
    base = work_folder(spark, "landing")
    named = {"vendor_txt": "VendorID", "pickup_txt": n.PICKUP, "dropoff_txt": n.DROPOFF,
             "passengers_txt": n.PASSENGERS, "amount_txt": n.AMOUNT}
    rows = trips_text(trips(spark, sf_dir)).withColumnsRenamed(named)
    rows = rows.withColumn("month", F.date_format(n.MONTH, "yyyy-MM")).drop(n.MONTH)
    arrange(rows, ("month",)).write.mode("overwrite").partitionBy("month").parquet(base)
    span = trips(spark, sf_dir).agg(F.min(n.MONTH), F.max(n.MONTH)).first()
    first, last = f"{span[0]:%Y-%m}", f"{span[1]:%Y-%m}"
    with lake(spark) as place:
        load_raw(spark, RawLoad(base, place.raw(), first, last, "2001-12-01 12:00:00", LANDED_AS))
        job = TrustedLoad(place.name("raw"), place.staging(), place.trusted(), place.quarantine(), first, last,
                          PASSING, max_pct_error="100", max_pct_type="100")
        load_trusted(spark, job)
        return place.files("quarantine")
