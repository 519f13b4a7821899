"""What each registered query must return, as SQL for DuckDB."""

from __future__ import annotations

from tripledger.checks.queries import END, START, rule_keys

TRIPS = """
b AS (
  SELECT *, (l_orderkey*7 + l_linenumber*31 + l_partkey*13 + l_suppkey) % 1000 AS h,
         CAST(epoch(l_shipdate) AS BIGINT) + (l_orderkey*977 + l_linenumber*3571) % 86400 AS pu
  FROM lineitem),
d AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE h BETWEEN 20 AND 29),
trips AS (
SELECT
  CASE h WHEN 0 THEN NULL WHEN 1 THEN 6 WHEN 2 THEN 0 WHEN 3 THEN -1 ELSE 1 + l_suppkey % 2 END AS VendorID,
  CASE WHEN h = 4 THEN NULL ELSE make_timestamp((pu)*1000000) END AS tpep_pickup_datetime,
  CASE h WHEN 5 THEN NULL
         WHEN 6 THEN make_timestamp((pu)*1000000)
         WHEN 7 THEN make_timestamp((pu - 300)*1000000)
         WHEN 8 THEN make_timestamp((pu + 90000)*1000000)
         WHEN 9 THEN make_timestamp((pu + 30)*1000000)
         WHEN 10 THEN make_timestamp((pu + 86400)*1000000)
         WHEN 11 THEN make_timestamp((pu + 60)*1000000)
         ELSE make_timestamp((pu + 120 + l_partkey % 3600)*1000000) END AS tpep_dropoff_datetime,
  CASE h WHEN 12 THEN NULL WHEN 13 THEN CAST(-1 AS DOUBLE) WHEN 14 THEN CAST(10 AS DOUBLE)
         WHEN 15 THEN CAST(1.9 AS DOUBLE)
         ELSE CAST(CAST(l_quantity AS INT) % 7 AS DOUBLE) END AS passenger_count,
  CASE h WHEN 16 THEN NULL WHEN 17 THEN -l_extendedprice/1000 WHEN 18 THEN CAST(0 AS DOUBLE)
         WHEN 19 THEN l_extendedprice ELSE l_extendedprice/1000 END AS total_amount,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS date_reference,
  CASE WHEN l_shipdate < TIMESTAMP '1997-03-01 00:00:00' THEN DATE '2001-11-30'
       ELSE DATE '2001-12-01' END AS insertion_date
FROM d)"""

CORE = """
core AS (
SELECT CAST(VendorID AS INTEGER) AS vendor_id, tpep_pickup_datetime, tpep_dropoff_datetime,
       CAST(trunc(passenger_count) AS INTEGER) AS passenger_count, total_amount, date_reference, insertion_date,
       0 AS bad_vendor, 0 AS bad_pickup, 0 AS bad_dropoff, 0 AS bad_passengers, 0 AS bad_amount
FROM trips)"""

TEXT = """
trips_text AS (
SELECT
  CASE WHEN sec % 501 = 0 THEN 'abc'   ELSE CAST(VendorID AS VARCHAR) END AS vendor_txt,
  CASE WHEN sec % 503 = 0 THEN 'soon'  ELSE CAST(tpep_pickup_datetime AS VARCHAR) END AS pickup_txt,
  CASE WHEN sec % 509 = 0 THEN 'later' ELSE CAST(tpep_dropoff_datetime AS VARCHAR) END AS dropoff_txt,
  CASE WHEN sec % 521 = 0 THEN 'two'   ELSE CAST(passenger_count AS VARCHAR) END AS passengers_txt,
  CASE WHEN sec % 523 = 0 THEN 'x'     ELSE CAST(total_amount AS VARCHAR) END AS amount_txt,
  date_reference
FROM (SELECT *, CAST(floor(epoch(tpep_pickup_datetime)) AS BIGINT) AS sec FROM trips))"""

CORE_OF_TEXT = """
core AS (
SELECT try_cast(vendor_txt AS INTEGER) AS vendor_id,
       try_cast(pickup_txt AS TIMESTAMP) AS tpep_pickup_datetime,
       try_cast(dropoff_txt AS TIMESTAMP) AS tpep_dropoff_datetime,
       CAST(trunc(try_cast(passengers_txt AS DOUBLE)) AS INTEGER) AS passenger_count,
       try_cast(amount_txt AS DOUBLE) AS total_amount, date_reference,
       CASE WHEN vendor_txt IS NOT NULL AND try_cast(vendor_txt AS INTEGER) IS NULL THEN 1 ELSE 0 END AS bad_vendor,
       CASE WHEN pickup_txt IS NOT NULL AND try_cast(pickup_txt AS TIMESTAMP) IS NULL THEN 1 ELSE 0 END AS bad_pickup,
       CASE WHEN dropoff_txt IS NOT NULL AND try_cast(dropoff_txt AS TIMESTAMP) IS NULL THEN 1 ELSE 0 END
         AS bad_dropoff,
       CASE WHEN passengers_txt IS NOT NULL AND try_cast(passengers_txt AS DOUBLE) IS NULL THEN 1 ELSE 0 END
         AS bad_passengers,
       CASE WHEN amount_txt IS NOT NULL AND try_cast(amount_txt AS DOUBLE) IS NULL THEN 1 ELSE 0 END AS bad_amount
FROM trips_text)"""

PASS, FAIL = ("2001-12-01 00:00:00", 3650), ("2001-07-01 00:00:00", 2190)
SECONDS = "CAST(floor(epoch(tpep_dropoff_datetime)) - floor(epoch(tpep_pickup_datetime)) AS BIGINT)"

# Flag -> condition per pack, reason label, metric, report name, report section.
CODED_CONDITIONS = {
    "falha_tipo_vendor_id": "bad_vendor = 1",
    "falha_tipo_pickup_datetime": "bad_pickup = 1",
    "falha_tipo_dropoff_datetime": "bad_dropoff = 1",
    "falha_tipo_passenger_count": "bad_passengers = 1",
    "falha_tipo_total_amount": "bad_amount = 1",
    "falha_vendor_id_nulo": "vendor_id IS NULL AND bad_vendor = 0",
    "falha_pickup_nulo": "tpep_pickup_datetime IS NULL AND bad_pickup = 0",
    "falha_dropoff_nulo": "false",
    "falha_passenger_count_nulo": "passenger_count IS NULL AND bad_passengers = 0",
    "falha_total_amount_nulo": "total_amount IS NULL AND bad_amount = 0",
    "falha_vendor_id_invalido": "vendor_id < 0",
    "falha_passenger_count_invalido": "passenger_count < 0",
    "falha_dropoff_antes_pickup": "tpep_dropoff_datetime <= tpep_pickup_datetime",
    "falha_duracao_excessiva": f"{SECONDS} > 86400",
    "falha_duracao_muito_curta": f"{SECONDS} < 60",
    "falha_pickup_futuro": "tpep_pickup_datetime > TIMESTAMP '{as_of}'",
    "falha_pickup_muito_antigo": "tpep_pickup_datetime < CAST(DATE '{day}' - {days} AS TIMESTAMP)",
}
DOCUMENTED_CONDITIONS = {}
for _flag, _condition in CODED_CONDITIONS.items():
    DOCUMENTED_CONDITIONS[_flag] = _condition
    if _flag == "falha_passenger_count_invalido":
        DOCUMENTED_CONDITIONS["falha_total_amount_invalido"] = "total_amount <= 0 OR total_amount > 1000"
DOCUMENTED_CONDITIONS["falha_dropoff_nulo"] = "tpep_dropoff_datetime IS NULL AND bad_dropoff = 0"
DOCUMENTED_CONDITIONS["falha_vendor_id_invalido"] = "vendor_id NOT BETWEEN 1 AND 4"
DOCUMENTED_CONDITIONS["falha_passenger_count_invalido"] = "passenger_count < 0 OR passenger_count > 9"
CONDITIONS = {"coded": CODED_CONDITIONS, "documented": DOCUMENTED_CONDITIONS}

LABELS = {
    "falha_tipo_vendor_id": "TIPO_VENDOR_ID_INVALIDO",
    "falha_tipo_pickup_datetime": "TIPO_PICKUP_INVALIDO",
    "falha_tipo_dropoff_datetime": "TIPO_DROPOFF_INVALIDO",
    "falha_tipo_passenger_count": "TIPO_PASSENGER_INVALIDO",
    "falha_tipo_total_amount": "TIPO_AMOUNT_INVALIDO",
    "falha_vendor_id_nulo": "VENDOR_ID_NULO",
    "falha_pickup_nulo": "PICKUP_NULO",
    "falha_dropoff_nulo": "DROPOFF_NULO",
    "falha_passenger_count_nulo": "PASSENGER_COUNT_NULO",
    "falha_total_amount_nulo": "TOTAL_AMOUNT_NULO",
    "falha_vendor_id_invalido": "VENDOR_ID_FORA_RANGE",
    "falha_passenger_count_invalido": "PASSENGER_COUNT_FORA_RANGE",
    "falha_total_amount_invalido": "TOTAL_AMOUNT_FORA_RANGE",
    "falha_dropoff_antes_pickup": "DROPOFF_ANTES_PICKUP",
    "falha_duracao_excessiva": "DURACAO_EXCESSIVA",
    "falha_duracao_muito_curta": "DURACAO_MUITO_CURTA",
    "falha_pickup_futuro": "PICKUP_DATA_FUTURA",
    "falha_pickup_muito_antigo": "PICKUP_MUITO_ANTIGO",
}
METRICS = {
    "falha_tipo_vendor_id": "qtd_erro_tipo_vendor_id",
    "falha_tipo_pickup_datetime": "qtd_erro_tipo_pickup",
    "falha_tipo_dropoff_datetime": "qtd_erro_tipo_dropoff",
    "falha_tipo_passenger_count": "qtd_erro_tipo_passenger",
    "falha_tipo_total_amount": "qtd_erro_tipo_amount",
    "falha_vendor_id_nulo": "qtd_vendor_id_nulo",
    "falha_pickup_nulo": "qtd_pickup_nulo",
    "falha_dropoff_nulo": "qtd_dropoff_nulo",
    "falha_passenger_count_nulo": "qtd_passenger_nulo",
    "falha_total_amount_nulo": "qtd_amount_nulo",
    "falha_vendor_id_invalido": "qtd_vendor_id_invalido",
    "falha_passenger_count_invalido": "qtd_passenger_invalido",
    "falha_total_amount_invalido": "qtd_amount_invalido",
    "falha_dropoff_antes_pickup": "qtd_dropoff_antes_pickup",
    "falha_duracao_excessiva": "qtd_duracao_excessiva",
    "falha_duracao_muito_curta": "qtd_duracao_muito_curta",
    "falha_pickup_futuro": "qtd_pickup_futuro",
    "falha_pickup_muito_antigo": "qtd_pickup_muito_antigo",
}
REPORT_LINES = {
    "types": {
        "vendor_id_tipo_invalido": "qtd_erro_tipo_vendor_id",
        "pickup_tipo_invalido": "qtd_erro_tipo_pickup",
        "dropoff_tipo_invalido": "qtd_erro_tipo_dropoff",
        "passenger_count_tipo_invalido": "qtd_erro_tipo_passenger",
        "total_amount_tipo_invalido": "qtd_erro_tipo_amount",
    },
    "nulls": {
        "qtd_vendor_id_nulo": "qtd_vendor_id_nulo",
        "qtd_pickup_nulo": "qtd_pickup_nulo",
        "qtd_dropoff_nulo": "qtd_dropoff_nulo",
        "qtd_passenger_nulo": "qtd_passenger_nulo",
        "qtd_amount_nulo": "qtd_amount_nulo",
    },
    "ranges": {
        "vendor_fora_range": "qtd_vendor_id_invalido",
        "passenger_fora_range": "qtd_passenger_invalido",
        "amount_fora_range": "qtd_amount_invalido",
    },
    "logic": {
        "dropoff_antes_pickup": "qtd_dropoff_antes_pickup",
        "viagens_muito_longas": "qtd_duracao_excessiva",
        "viagens_muito_curtas": "qtd_duracao_muito_curta",
        "datas_futuras": "qtd_pickup_futuro",
        "datas_muito_antigas": "qtd_pickup_muito_antigo",
    },
}


def _flags(limits=PASS, pack="coded") -> str:
    as_of, days = limits
    fill = {"as_of": as_of, "day": as_of[:10], "days": days}
    conditions = {flag: c.format(**fill) for flag, c in CONDITIONS[pack].items()}
    columns = ",\n  ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS {flag}" for flag, c in conditions.items())
    return f"""
flagged AS (
SELECT * EXCLUDE (bad_vendor, bad_pickup, bad_dropoff, bad_passengers, bad_amount),
  {columns},
  CASE WHEN vendor_id IS NULL OR tpep_pickup_datetime IS NULL OR tpep_dropoff_datetime IS NULL
         OR passenger_count IS NULL OR total_amount IS NULL
         OR vendor_id NOT BETWEEN 1 AND 4 OR passenger_count < 0 OR passenger_count > 9
         OR total_amount <= 0 OR total_amount > 1000
         OR tpep_dropoff_datetime <= tpep_pickup_datetime OR {SECONDS} > 86400 OR {SECONDS} < 60
         OR {conditions["falha_pickup_futuro"]} OR {conditions["falha_pickup_muito_antigo"]}
       THEN 1 ELSE 0 END AS tem_erro
FROM core)"""


def _any(*flags: str) -> str:
    return " + ".join(flags) + " > 0"


TYPE_FLAGS = list(CODED_CONDITIONS)[:5]
NULL_FLAGS = list(CODED_CONDITIONS)[5:10]


def _rejected(limits=PASS, pack="coded") -> str:
    labels = ", ".join(f"CASE WHEN {flag} = 1 THEN '{LABELS[flag]}' END" for flag in CONDITIONS[pack])
    return f"""
rejected AS (
SELECT *, TIMESTAMP '{limits[0]}' AS data_hora_quarentena,
  concat_ws(' | ', {labels}) AS motivos_erro,
  CASE WHEN {_any(*TYPE_FLAGS)} THEN 'ERRO_TIPAGEM'
       WHEN {_any(*NULL_FLAGS)} THEN 'ERRO_NULO'
       WHEN falha_dropoff_antes_pickup + falha_duracao_excessiva + falha_duracao_muito_curta > 0
         THEN 'ERRO_LOGICA_NEGOCIO'
       ELSE 'ERRO_VALIDACAO_RANGE' END AS tipo_erro,
  CAST(DATE '{limits[0][:10]}' AS VARCHAR) AS data_particao_quarentena
FROM flagged WHERE tem_erro = 1)"""


def _half_up(part: str) -> str:
    """Percentage with two places, rounded half up in whole numbers."""
    return f"CAST((20000 * ({part}) + total_registros) // (2 * total_registros) AS DECIMAL(20, 0))"


def _metrics(pack="coded") -> str:
    sums = ", ".join(f"CAST(sum({flag}) AS BIGINT) AS {METRICS[flag]}" for flag in CONDITIONS[pack])
    types = " + ".join(METRICS[flag] for flag in TYPE_FLAGS)
    hundredth = "CAST(0.01 AS DECIMAL(3, 2))"
    return f"""
totals AS (
SELECT count(*) AS total_registros, CAST(sum(tem_erro) AS BIGINT) AS total_erros, {sums} FROM flagged),
metrics AS (
SELECT *, total_registros - total_erros AS total_validos,
  {_half_up("total_erros")} * {hundredth} AS percentual_erro,
  {_half_up("total_registros - total_erros")} * {hundredth} AS percentual_validos,
  {_half_up(types)} * {hundredth} AS percentual_erro_tipagem
FROM totals)"""


def _sql(select: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select.strip()


TRIP_COLUMNS = (
    "VendorID, tpep_pickup_datetime, tpep_dropoff_datetime, passenger_count, total_amount, "
    "CAST(date_reference AS VARCHAR) AS date_reference, CAST(insertion_date AS VARCHAR) AS insertion_date"
)
STAGED_COLUMNS = TRIP_COLUMNS.replace("VendorID", "vendor_id")
TRUSTED_COLUMNS = "vendor_id, tpep_pickup_datetime, tpep_dropoff_datetime, passenger_count, total_amount"
IN_RANGE = f"date_reference BETWEEN DATE '{START}-01' AND DATE '{END}-01'"
IN_JAN_MAY = "tpep_pickup_datetime >= TIMESTAMP '1997-01-01' AND tpep_pickup_datetime < TIMESTAMP '1997-06-01'"
TRUSTED = "trusted AS (SELECT CAST(vendor_id AS BIGINT) AS vendor_id, tpep_pickup_datetime, tpep_dropoff_datetime, " \
          "passenger_count, total_amount FROM flagged WHERE tem_erro = 0)"
WITH_DATES = (
    "* REPLACE (CAST(date_reference AS VARCHAR) AS date_reference, CAST(insertion_date AS VARCHAR) AS insertion_date)"
)
STORED = WITH_DATES.replace("REPLACE (", "REPLACE (CAST(vendor_id AS BIGINT) AS vendor_id, ")
MONTHS = """
bounds AS (
SELECT min(day) AS lo, max(day) AS hi FROM (
  SELECT CAST(o_orderdate AS DATE) AS day FROM orders UNION ALL SELECT CAST(ts AS DATE) FROM events)),
spine AS (
SELECT CAST(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE)
  AS month FROM bounds)"""
CALENDAR = "CAST(CAST({0} AS DATE) AS VARCHAR) AS {0}"


def _nulls(columns: dict[str, str]) -> str:
    kinds = {"bigint": "BIGINT", "timestamp": "TIMESTAMP", "double": "DOUBLE", "string": "VARCHAR", "date": "VARCHAR"}
    return ", ".join(f"CAST(NULL AS {kinds[kind]}) AS {name}" for name, kind in columns.items())


# --- fixed values: the tables' columns and types, written out on purpose: what they are checked
# against must not come from the package under test ------------------------------------
RAW_TYPES = {
    "VendorID": "bigint", "tpep_pickup_datetime": "timestamp", "tpep_dropoff_datetime": "timestamp",
    "passenger_count": "double", "trip_distance": "double", "RatecodeID": "double",
    "store_and_fwd_flag": "string", "PULocationID": "bigint", "DOLocationID": "bigint",
    "payment_type": "bigint", "fare_amount": "double", "extra": "double", "mta_tax": "double",
    "tip_amount": "double", "tolls_amount": "double", "improvement_surcharge": "double",
    "total_amount": "double", "congestion_surcharge": "double", "airport_fee": "double",
    "date_reference": "date", "insertion_date": "date",
}
TRUSTED_TYPES = {
    "vendor_id": "bigint", "tpep_pickup_datetime": "timestamp", "tpep_dropoff_datetime": "timestamp",
    "passenger_count": "int", "total_amount": "double",
}
STAGING_TYPES = {**TRUSTED_TYPES, "date_reference": "date", "insertion_date": "date"}
STAMP_TYPES = {
    "tem_erro": "int", "data_hora_quarentena": "timestamp", "motivos_erro": "string", "tipo_erro": "string",
    "data_particao_quarentena": "date",
}
TRIP_NAMES = ["VendorID", "tpep_pickup_datetime", "tpep_dropoff_datetime", "passenger_count", "total_amount",
              "date_reference", "insertion_date"]
ABSENT = {name: kind for name, kind in RAW_TYPES.items() if name not in TRIP_NAMES}
DELIVERED = """
delivered AS (
SELECT total_amount, CASE WHEN CAST(floor(epoch(tpep_pickup_datetime)) AS BIGINT) % 501 = 0 THEN 'abc'
         ELSE CAST(VendorID AS VARCHAR) END AS vendor_text,
       'x' AS unknown_column, tpep_dropoff_datetime, tpep_pickup_datetime,
       CAST(trunc(passenger_count) AS INTEGER) AS passenger_count, date_reference
FROM trips)"""


def _filled(table: str, columns: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS column_name, {extra}, {'count(' + source + ')' if source else 'CAST(0 AS BIGINT)'} "
        f"AS filled FROM {table}"
        for name, (extra, source) in columns.items()
    )


MONTHLY = """
SELECT CAST(year(tpep_pickup_datetime) AS INTEGER) AS ano, CAST(month(tpep_pickup_datetime) AS INTEGER) AS mes,
       strftime(tpep_pickup_datetime, '%Y-%m') AS periodo, round(avg(total_amount), 2) AS media_valor_total,
       count(*) AS total_corridas, round(sum(total_amount), 2) AS valor_total_periodo,
       round(min(total_amount), 2) AS valor_minimo, round(max(total_amount), 2) AS valor_maximo
FROM trusted WHERE total_amount > 0 {more} GROUP BY ALL ORDER BY ano, mes"""
HOURLY = """
SELECT CAST(hour(tpep_pickup_datetime) AS INTEGER) AS hora_do_dia,
       round(avg(passenger_count), 2) AS media_passageiros, count(*) AS total_corridas,
       CAST(round(sum(passenger_count), 0) AS BIGINT) AS total_passageiros,
       min(passenger_count) AS min_passageiros, max(passenger_count) AS max_passageiros
FROM trusted WHERE passenger_count > 0 AND tpep_pickup_datetime >= TIMESTAMP '{first}'
  AND tpep_pickup_datetime < TIMESTAMP '{until}' GROUP BY ALL ORDER BY hora_do_dia"""


def _gate(name: str, observed: str, rows: str, limit: str) -> str:
    return (
        f"SELECT '{name}' AS gate, CAST({rows} AS BIGINT) AS rows_in_error, CAST({observed} AS DOUBLE) AS observed, "
        f"CAST({limit} AS DOUBLE) AS threshold, {observed} <= {limit} AS passed FROM "
    )


def _renamed(suffix: str, *ctes: str) -> str:
    """A second copy of the rule steps under other names, for queries that need two."""
    text = ",".join(ctes)
    for name in ("core", "flagged", "totals", "metrics"):
        text = text.replace(f"{name} AS (", f"{name}{suffix} AS (").replace(f"FROM {name})", f"FROM {name}{suffix})")
    return text


def _report(section: str, pack: str = "coded") -> str:
    known = {METRICS[flag] for flag in CONDITIONS[pack]}
    return ", ".join(f"{metric} AS {name}" for name, metric in REPORT_LINES[section].items() if metric in known)


def oracle_sql() -> dict[str, str]:
    flags, flags_fail = _flags(), _flags(FAIL)
    doc, doc_fail = _flags(PASS, "documented"), _flags(FAIL, "documented")
    valid = (TRIPS, CORE, flags, TRUSTED)
    o: dict[str, str] = {}

    # Sources and tables.
    o["scan_month"] = _sql(f"SELECT {TRIP_COLUMNS} FROM trips WHERE date_reference = DATE '1997-03-01'", TRIPS)
    o["landing_gaps"] = _sql(
        "SELECT CAST(month AS VARCHAR) AS month, CAST(year(month) AS INTEGER) AS year, "
        "CAST(month(month) AS INTEGER) AS month_number FROM spine "
        "WHERE month NOT IN (SELECT date_reference FROM trips)",
        TRIPS, MONTHS,
    )
    o["catalog_setup"] = _sql(
        "SELECT CAST(date_reference AS VARCHAR) AS date_reference, count(*) AS rows FROM trips GROUP BY ALL", TRIPS
    )
    o["catalog_listing"] = _sql(
        "SELECT 'spark_catalog' AS catalog, 'scratch' AS comment, 'raw' AS table_name, count(*) AS rows FROM trips "
        "UNION ALL SELECT 'spark_catalog', 'scratch', 'trusted', count(*) FROM trusted",
        *valid,
    )

    def told(table: str, source: str, types: dict[str, str], plain: tuple[str, ...] = (), **held: str) -> str:
        """Columns of a table; ``plain`` have no comment, ``held`` names the source's column where it differs."""
        return "\nUNION ALL\n".join(
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{kind}' AS data_type, {int(c not in plain)} "
            f"AS has_comment, count({held.get(c, c)}) AS filled FROM {source}"
            for c, kind in types.items()
        )

    flag_types, month = dict.fromkeys(TYPE_FLAGS, "int"), {"data_particao": "date"}
    quarantine = {**STAGING_TYPES, **dict.fromkeys(CODED_CONDITIONS, "int"), **STAMP_TYPES}
    pickup_month = {"data_particao": "tpep_pickup_datetime"}
    o["describe_contract"] = _sql(
        "\nUNION ALL\n".join([
            told("raw", "trips", {**RAW_TYPES, **flag_types}, **dict.fromkeys(ABSENT, "NULL"), **dict.fromkeys(TYPE_FLAGS, "*")),
            told("staging", "core", {**STAGING_TYPES, **flag_types, **month}, **pickup_month, **dict.fromkeys(TYPE_FLAGS, "*")),
            told("trusted", "trusted", {**TRUSTED_TYPES, **month}, **pickup_month),
            told("quarantine", "rejected", quarantine, tuple(CODED_CONDITIONS)),
        ]),
        *valid, _rejected(),
    )
    o["table_detail"] = _sql(
        """SELECT 'raw' AS table_name, 'parquet' AS provider, 'date_reference' AS partitions, count(*) AS rows
           FROM trips
           UNION ALL SELECT 'staging', 'parquet', 'data_particao', count(*) FROM trips
           UNION ALL SELECT 'trusted', 'parquet', 'data_particao', count(*) FROM flagged WHERE tem_erro = 0
           UNION ALL SELECT 'quarantine', 'parquet', 'data_particao_quarentena,tipo_erro', count(*)
           FROM flagged WHERE tem_erro = 1""",
        TRIPS, CORE, flags,
    )

    # Projections, parameters, filters.
    o["project_core"] = _sql(f"SELECT {STAGED_COLUMNS} FROM core", TRIPS, CORE)
    o["project_core_flagged"] = _sql(
        f"SELECT {TRUSTED_COLUMNS}, CAST(date_reference AS VARCHAR) AS date_reference, "
        "bad_vendor AS falha_tipo_vendor_id, bad_pickup AS falha_tipo_pickup_datetime, "
        "bad_dropoff AS falha_tipo_dropoff_datetime, bad_passengers AS falha_tipo_passenger_count, "
        "bad_amount AS falha_tipo_total_amount FROM core",
        TRIPS, TEXT, CORE_OF_TEXT,
    )
    o["month_range_filter"] = _sql(f"SELECT {TRIP_COLUMNS} FROM trips WHERE {IN_RANGE}", TRIPS)
    newest = "insertion_date = (SELECT max(insertion_date) FROM trips)"
    o["latest_load_filter"] = _sql(f"SELECT {TRIP_COLUMNS} FROM trips WHERE {newest}", TRIPS)
    o["staged_batch"] = _sql(f"SELECT {STAGED_COLUMNS} FROM core WHERE {IN_RANGE} AND {newest}", TRIPS, CORE)
    o["positive_filter"] = _sql(
        f"SELECT {STAGED_COLUMNS} FROM core WHERE total_amount > 0 AND core.passenger_count > 0", TRIPS, CORE
    )
    o["calendar_range_filter"] = _sql(
        f"SELECT {STAGED_COLUMNS} FROM core "
        "WHERE year(tpep_pickup_datetime) = 1997 AND month(tpep_pickup_datetime) <= 5",
        TRIPS, CORE,
    )
    o["param_query"] = _sql(
        "SELECT CAST(date_reference AS VARCHAR) AS date_reference, count(*) AS rows, "
        f"count(VendorID) AS vendors_filled FROM trips WHERE {IN_RANGE} GROUP BY ALL",
        TRIPS,
    )
    o["month_format_filter"] = _sql(
        "SELECT substr(pickup_txt, 1, 7) AS month_text, count(*) AS rows FROM trips_text "
        "WHERE regexp_full_match(substr(pickup_txt, 1, 7), '[0-9]{4}-(0[1-9]|1[0-2])') GROUP BY ALL",
        TRIPS, TEXT,
    )
    o["month_spine"] = _sql(
        """SELECT CAST(CAST(m AS DATE) AS VARCHAR) AS month, CAST(year(m) AS INTEGER) AS year,
                  CAST(month(m) AS INTEGER) AS month_number
           FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m
                 FROM (SELECT min(date_reference) AS lo, max(date_reference) AS hi FROM trips))""",
        TRIPS,
    )

    # Conformance.
    found = {
        "total_amount": ("'renamed' AS state", "total_amount"),
        "VendorID": ("'renamed' AS state", "vendor_text"),
        "unknown_column": ("'extra' AS state", "unknown_column"),
        "tpep_dropoff_datetime": ("'matched' AS state", "tpep_dropoff_datetime"),
        "tpep_pickup_datetime": ("'matched' AS state", "tpep_pickup_datetime"),
        "passenger_count": ("'matched' AS state", "passenger_count"),
        "date_reference": ("'matched' AS state", "date_reference"),
    }
    missing = {name: ("'missing' AS state", "") for name in RAW_TYPES if name not in found}
    o["schema_diff"] = _sql(
        _filled("delivered", {**found, **missing}).replace(
            "CAST(0 AS BIGINT) AS filled FROM delivered", "CAST(0 AS BIGINT) AS filled"
        ),
        TRIPS, DELIVERED,
    )
    day = CALENDAR.format("date_reference")
    o["normalize_names"] = _sql(
        "SELECT total_amount, vendor_text AS VendorID, unknown_column, tpep_dropoff_datetime, tpep_pickup_datetime, "
        f"passenger_count, {day} FROM delivered",
        TRIPS, DELIVERED,
    )
    o["add_missing"] = _sql(f"SELECT {TRIP_COLUMNS}, {_nulls(ABSENT)} FROM trips", TRIPS)
    typed = (
        "try_cast(vendor_text AS BIGINT) AS VendorID, tpep_pickup_datetime, tpep_dropoff_datetime, "
        f"CAST(passenger_count AS DOUBLE) AS passenger_count, total_amount, {day}"
    )
    o["cast_contract"] = _sql(f"SELECT {typed}, unknown_column FROM delivered", TRIPS, DELIVERED)
    o["conform"] = _sql(
        f"SELECT {typed}, {_nulls({**ABSENT, 'insertion_date': 'date'})} FROM delivered", TRIPS, DELIVERED
    )
    o["add_load_metadata"] = _sql(
        "SELECT VendorID, tpep_pickup_datetime, tpep_dropoff_datetime, passenger_count, total_amount, "
        "'1997-03-01' AS date_reference, '2001-11-30' AS insertion_date FROM trips",
        TRIPS,
    )
    o["non_empty_gate"] = _sql(
        "SELECT CAST(month AS VARCHAR) AS month, count(date_reference) AS rows, count(date_reference) > 0 AS passed "
        "FROM spine LEFT JOIN trips ON month = date_reference GROUP BY spine.month",
        TRIPS, MONTHS,
    )

    # Row rules.
    for key, (rule, pack) in rule_keys().items():
        late = rule.flag in ("falha_pickup_futuro", "falha_pickup_muito_antigo")
        steps = (TRIPS, TEXT, CORE_OF_TEXT) if rule.flag in TYPE_FLAGS else (TRIPS, CORE)
        o[key] = _sql(
            f"SELECT {day}, count(*) AS rows, CAST(sum({rule.flag}) AS BIGINT) AS flagged FROM flagged "
            "GROUP BY flagged.date_reference",
            *steps, _flags(FAIL if late else PASS, pack),
        )
    o["row_verdict"] = _sql(
        f"SELECT {day}, tem_erro, count(*) AS rows FROM flagged GROUP BY flagged.date_reference, tem_erro",
        TRIPS, CORE, flags_fail,
    )
    patterns = "SELECT tipo_erro, motivos_erro, count(*) AS rows FROM rejected GROUP BY ALL"
    o["error_reasons"] = _sql(patterns, TRIPS, CORE, flags_fail, _rejected(FAIL))
    o["error_reasons_documented"] = _sql(patterns, TRIPS, CORE, doc_fail, _rejected(FAIL, "documented"))
    classes = "SELECT tipo_erro, count(*) AS rows FROM rejected GROUP BY ALL"
    o["error_class"] = _sql(classes, TRIPS, TEXT, CORE_OF_TEXT, flags, _rejected())
    o["error_class_documented"] = _sql(classes, TRIPS, TEXT, CORE_OF_TEXT, doc, _rejected(PASS, "documented"))
    o["flagged_rows"] = _sql(f"SELECT {WITH_DATES} FROM flagged", TRIPS, CORE, flags_fail)
    o["sql_flagged_rows"] = o["flagged_rows"]
    o["quarantine_rows"] = _sql(f"SELECT {WITH_DATES} FROM rejected", TRIPS, CORE, flags, _rejected())
    o["split_valid"] = _sql("SELECT * FROM trusted", *valid)
    o["split_quarantine"] = _sql(f"SELECT {WITH_DATES} FROM flagged WHERE tem_erro = 1", TRIPS, CORE, flags)

    # Metrics, reports, gates.
    numbers = (
        "* REPLACE (CAST(percentual_erro AS DOUBLE) AS percentual_erro, "
        "CAST(percentual_validos AS DOUBLE) AS percentual_validos, "
        "CAST(percentual_erro_tipagem AS DOUBLE) AS percentual_erro_tipagem)"
    )
    of_text = (TRIPS, TEXT, CORE_OF_TEXT, flags, _metrics())
    o["quality_metrics"] = _sql(f"SELECT {numbers} FROM metrics", TRIPS, CORE, flags_fail, _metrics())
    o["quality_metrics_documented"] = _sql(
        f"SELECT {numbers} FROM metrics", TRIPS, CORE, doc_fail, _metrics("documented")
    )
    o["quality_percentages"] = _sql(
        "SELECT CAST(percentual_erro AS DOUBLE) AS percentual_erro, "
        "CAST(percentual_validos AS DOUBLE) AS percentual_validos, "
        "CAST(percentual_erro_tipagem AS DOUBLE) AS percentual_erro_tipagem FROM metrics",
        *of_text,
    )
    sign = "CAST({} AS VARCHAR) || '%'"
    o["report_summary"] = _sql(
        "SELECT total_registros AS total_processado, total_validos AS aprovados, total_erros AS reprovados, "
        f"{sign.format('percentual_validos')} AS taxa_aprovacao, {sign.format('percentual_erro')} AS taxa_erro "
        "FROM metrics",
        TRIPS, CORE, flags, _metrics(),
    )
    o["report_types"] = _sql(
        f"SELECT {_report('types')}, {sign.format('percentual_erro_tipagem')} AS percentual_erro_tipo FROM metrics",
        *of_text,
    )
    o["report_nulls"] = _sql(f"SELECT {_report('nulls')} FROM metrics", TRIPS, CORE, flags, _metrics())
    o["report_ranges"] = _sql(f"SELECT {_report('ranges')} FROM metrics", TRIPS, CORE, flags, _metrics())
    o["report_logic"] = _sql(f"SELECT {_report('logic')} FROM metrics", TRIPS, CORE, flags_fail, _metrics())
    o["report_long"] = _sql(
        "\nUNION ALL\n".join(
            f"SELECT '{section}' AS section, '{name}' AS rule, {metric} AS rows FROM metrics"
            for section, lines in REPORT_LINES.items()
            for name, metric in lines.items()
        ),
        TRIPS, CORE, doc_fail, _metrics("documented"),
    )
    o["sql_report"] = o["report_long"]
    o["run_summary"] = _sql(
        "SELECT count(*) AS registros_quarentena, count(*) FILTER (tipo_erro = 'ERRO_TIPAGEM') AS erros_tipagem, "
        "count(*) FILTER (tipo_erro = 'ERRO_LOGICA_NEGOCIO') AS erros_logica_negocio FROM rejected",
        TRIPS, TEXT, CORE_OF_TEXT, flags, _rejected(),
    )
    by_class = "SELECT data_particao_quarentena, tipo_erro, count(*) AS rows FROM rejected GROUP BY ALL"
    o["quarantine_by_class"] = _sql(by_class, TRIPS, CORE, flags_fail, _rejected(FAIL))
    error_gate = _gate("error_rate", "percentual_erro", "total_erros", "5.0")
    type_gate = _gate("type_rate", "percentual_erro_tipagem", "NULL", "0.1")
    o["gate_error_rate"] = _sql(
        f"{error_gate} metrics UNION ALL {error_gate} metrics2 "
        f"UNION ALL {_gate('error_rate', 'percentual_erro', 'total_erros', '0.125')} metrics2 "
        "UNION ALL SELECT 'error_rate', NULL, NULL, CAST(5.0 AS DOUBLE), false",
        TRIPS, CORE, flags, _metrics(), _renamed("2", CORE, flags_fail, _metrics()),
    )
    o["gate_type_rate"] = _sql(
        f"{type_gate} metrics UNION ALL {type_gate} metrics2 "
        f"UNION ALL {_gate('type_rate', 'percentual_erro_tipagem', 'NULL', '0.875')} metrics2",
        TRIPS, TEXT, CORE, flags, _metrics(), _renamed("2", CORE_OF_TEXT, flags, _metrics()),
    )

    # Writers.
    o["layout_write"] = _sql(f"SELECT {TRIP_COLUMNS} FROM trips", TRIPS)
    o["replace_month"] = _sql(
        f"SELECT {TRIP_COLUMNS}, CAST(CASE WHEN {IN_RANGE.replace('date_reference', 'trips.date_reference')} "
        "THEN 2 END AS BIGINT) AS payment_type FROM trips",
        TRIPS,
    )
    o["staging_lifecycle"] = _sql("SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM trips", TRIPS)
    o["export_parquet"] = _sql("SELECT * FROM trusted", *valid)
    o["export_csv"] = _sql(
        """SELECT * REPLACE (tpep_pickup_datetime + to_microseconds(123457 * passenger_count) AS tpep_pickup_datetime),
             CASE passenger_count WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' a ' WHEN 3 THEN 'say "x", y'
               WHEN 4 THEN 'two' || chr(10) || 'lines\\n' WHEN 5 THEN '\\N' ELSE 'plain' END AS note FROM trusted""",
        *valid,
    )
    keyless = "vendor_id IS NULL OR tpep_pickup_datetime IS NULL OR tpep_dropoff_datetime IS NULL"
    o["merge_staging"] = _sql(
        f"SELECT * REPLACE (CAST(vendor_id AS BIGINT) AS vendor_id) FROM (SELECT {STAGED_COLUMNS} FROM core "
        f"UNION ALL SELECT {STAGED_COLUMNS} FROM core WHERE {keyless})",
        TRIPS, CORE,
    )
    o["merge_trusted"] = o["merge_trusted_lookup"] = o["split_valid"]
    o["merge_trusted_bucketed"] = o["merge_resume"] = o["split_valid"]
    o["merge_trusted_hot_key"] = _sql(
        """SELECT * FROM trusted WHERE hour(tpep_pickup_datetime) >= 8 UNION ALL
           SELECT 2, TIMESTAMP '1997-03-01 00:00:00', TIMESTAMP '1997-03-01 00:30:00', 1, CAST(20.5 AS DOUBLE)
           FROM trusted WHERE hour(tpep_pickup_datetime) < 8""",
        *valid,
    )
    o["merge_trusted_deduped"] = _sql("SELECT DISTINCT * FROM trusted", *valid)
    twice = "* REPLACE (TIMESTAMP '2001-12-02 00:00:00' AS data_hora_quarentena, '2001-12-02' AS data_particao_quarentena)"
    o["merge_quarantine"] = _sql(
        f"SELECT {STORED} FROM rejected UNION ALL SELECT {STORED} FROM (SELECT {twice} FROM rejected)",
        TRIPS, CORE, flags, _rejected(),
    )
    o["merge_quarantine_documented"] = _sql(
        f"SELECT {STORED} FROM rejected", TRIPS, CORE, doc, _rejected(PASS, "documented")
    )
    day_of_pickup = "CAST(CAST(tpep_pickup_datetime AS DATE) AS VARCHAR)"
    o["merge_evolve"] = _sql(
        f"SELECT *, CASE WHEN {IN_JAN_MAY} THEN NULL ELSE {day_of_pickup} END AS pickup_date FROM trusted", *valid
    )
    o["dedupe_exact"] = _sql(f"SELECT DISTINCT {TRIP_COLUMNS} FROM trips", TRIPS)
    o["duplicate_keys"] = _sql(
        f"SELECT {TRUSTED_COLUMNS}, count(*) AS copies FROM trusted GROUP BY ALL HAVING count(*) > 1", *valid
    )

    # Rollups and profiles.
    monthly, everything = MONTHLY.format(more=f"AND {IN_JAN_MAY}"), MONTHLY.format(more="")
    o["monthly_amount"] = _sql(monthly, *valid)
    o["monthly_amount_all"] = _sql(
        f"SELECT ano, mes, media_valor_total, total_corridas FROM ({everything}) ORDER BY ano, mes", *valid
    )
    o["monthly_amount_short"] = _sql(
        f"SELECT ano, mes, periodo, media_valor_total FROM ({monthly}) ORDER BY ano, mes", *valid
    )
    hourly = HOURLY.format(first="1997-05-01", until="1997-06-01")
    hours = "SELECT hora_do_dia, media_passageiros, total_corridas FROM ({}) ORDER BY hora_do_dia"
    o["hourly_passengers"] = _sql(hourly, *valid)
    o["monthly_amount_kept"], o["hourly_passengers_kept"] = o["monthly_amount"], o["hourly_passengers"]
    o["hourly_passengers_short"] = _sql(hours.format(hourly), *valid)
    o["hourly_events"] = _sql(
        hours.format(HOURLY.format(first="2024-01-01", until="2024-02-01")),
        "trusted AS (SELECT ts AS tpep_pickup_datetime, CAST(trunc(value) AS INTEGER) AS passenger_count FROM events)",
    )
    o["raw_count"] = _sql("SELECT count(*) AS total_registros FROM trips", TRIPS)
    o["trusted_profile"] = _sql(
        "SELECT count(*) AS total_registros, count(DISTINCT vendor_id) AS vendors_unicos, "
        "min(tpep_pickup_datetime) AS primeira_corrida, max(tpep_pickup_datetime) AS ultima_corrida FROM trusted",
        *valid,
    )
    o["clean_profile"] = _sql(
        "SELECT count(*) AS total_registros, count(DISTINCT vendor_id) AS vendors_unicos, "
        "round(avg(total_amount), 2) AS media_valor, round(avg(passenger_count), 2) AS media_passageiros "
        "FROM trusted WHERE total_amount > 0 AND passenger_count > 0",
        *valid,
    )
    o["profiles_kept"] = _sql(
        "SELECT count(*) AS total_registros, count(DISTINCT vendor_id) AS vendors_unicos, min(tpep_pickup_datetime) AS primeira_corrida, "
        "max(tpep_pickup_datetime) AS ultima_corrida, CAST(NULL AS DOUBLE) AS media_valor, CAST(NULL AS DOUBLE) AS media_passageiros "
        "FROM trusted UNION ALL "
        "SELECT count(*), count(DISTINCT vendor_id), NULL, NULL, round(avg(total_amount), 2), round(avg(passenger_count), 2) "
        "FROM trusted WHERE total_amount > 0 AND passenger_count > 0",
        *valid,
    )
    o["coverage_profile"] = _sql(
        "SELECT 'Total de Registros' AS metrica, CAST(count(*) AS VARCHAR) AS valor FROM trips UNION ALL "
        "SELECT 'Período Coberto', CAST(min(date_reference) AS VARCHAR) || ' até ' || "
        "CAST(max(date_reference) AS VARCHAR) FROM trips",
        TRIPS,
    )
    o["trip_enrich"] = _sql(
        f"SELECT *, {SECONDS} AS duration_seconds, {day_of_pickup} AS pickup_date, "
        "strftime(tpep_pickup_datetime, '%Y-%m') AS pickup_period FROM trusted",
        *valid,
    )
    o["scalar_functions"] = _sql(
        f"""SELECT CAST(trunc(passenger_count) AS INTEGER) AS truncated, CAST(VendorID AS INTEGER) AS tried,
              CASE WHEN VendorID < 0 THEN 1 ELSE 0 END AS cased, strftime(tpep_pickup_datetime, '%Y-%m') AS label,
              concat_ws(' | ', CASE WHEN tpep_pickup_datetime IS NULL THEN 'P' END,
                               CASE WHEN tpep_dropoff_datetime IS NULL THEN 'D' END) AS joined,
              CAST(year(tpep_pickup_datetime) AS INTEGER) AS y, CAST(month(tpep_pickup_datetime) AS INTEGER) AS m,
              CAST(hour(tpep_pickup_datetime) AS INTEGER) AS hr,
              CAST(round(CAST(total_amount AS DECIMAL(18, 6)), 2) AS DOUBLE) AS rounded,
              {day_of_pickup} AS day,
              CAST(CAST(tpep_pickup_datetime AS DATE) - 3650 AS VARCHAR) AS ten_years_before,
              {SECONDS} AS seconds, CAST(date_reference AS VARCHAR) AS parsed,
              CAST(passenger_count BETWEEN 0 AND 9 AS INTEGER) AS seated,
              VendorID NOT BETWEEN 1 AND 4 AS outside,
              CASE WHEN total_amount > 1000 THEN 'high' END AS band, CAST(NULL AS VARCHAR) AS asserted
            FROM trips""",
        TRIPS,
    )

    # Whole loads.
    o["raw_load"] = _sql(
        "SELECT VendorID, tpep_pickup_datetime, tpep_dropoff_datetime, passenger_count, total_amount, "
        "CAST(date_reference AS VARCHAR) AS date_reference, '2001-12-01' AS insertion_date, "
        f"{_nulls(ABSENT)}, {', '.join(f'0 AS {flag}' for flag in TYPE_FLAGS)} "
        f"FROM trips WHERE {IN_RANGE.replace('date_reference', 'trips.date_reference')}",
        TRIPS,
    )
    newest_core = CORE.replace("FROM trips)", f"FROM trips WHERE {newest})")
    o["trusted_load"] = _sql(
        f"SELECT * FROM trusted UNION ALL BY NAME SELECT {WITH_DATES} FROM rejected "
        f"UNION ALL BY NAME SELECT {WITH_DATES} FROM rejected",
        TRIPS, newest_core, flags, TRUSTED, _rejected(),
    )
    o["trusted_load_published"] = o["trusted_load"]
    o["replace_month_published"] = o["replace_month"]
    as_loaded = CORE_OF_TEXT.replace("date_reference,", "date_reference, DATE '2001-12-01' AS insertion_date,", 1)
    o["load_text_types"] = _sql(f"SELECT {STORED} FROM rejected", TRIPS, TEXT, as_loaded, flags, _rejected())
    return o
