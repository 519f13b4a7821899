"""Names, labels and limits that results must carry unchanged."""

# --- fixed values: landing files -------------------------------------------------
LANDING_TEMPLATE = "yellow/yellow_tripdata_{year}-{month:02d}.parquet"
LANDING_ZONE = "America/Sao_Paulo"
MONTH_PATTERN = "^[0-9]{4}-(0[1-9]|1[0-2])$"

# --- fixed values: core columns of a trip ----------------------------------------
VENDOR = "vendor_id"
PICKUP = "tpep_pickup_datetime"
DROPOFF = "tpep_dropoff_datetime"
PASSENGERS = "passenger_count"
AMOUNT = "total_amount"
MONTH = "date_reference"
LOADED = "insertion_date"
PICKUP_MONTH = "data_particao"
CORE = [VENDOR, PICKUP, DROPOFF, PASSENGERS, AMOUNT]

# --- fixed values: verdict and quarantine columns --------------------------------
VERDICT = "tem_erro"
STAMP = "data_hora_quarentena"
REASONS = "motivos_erro"
ERROR_CLASS = "tipo_erro"
QUARANTINE_DAY = "data_particao_quarentena"
REASON_SEPARATOR = " | "

# --- fixed values: error classes, first match wins -------------------------------
CLASS_TYPE = "ERRO_TIPAGEM"
CLASS_NULL = "ERRO_NULO"
CLASS_LOGIC = "ERRO_LOGICA_NEGOCIO"
CLASS_RANGE = "ERRO_VALIDACAO_RANGE"

# --- fixed values: metric columns ------------------------------------------------
TOTAL_ROWS = "total_registros"
TOTAL_ERRORS = "total_erros"
TOTAL_VALID = "total_validos"
PCT_ERROR = "percentual_erro"
PCT_VALID = "percentual_validos"
PCT_TYPE = "percentual_erro_tipagem"

# --- fixed values: temporary views of a load --------------------------------------
FLAGGED_VIEW = "vw_taxi_validado"
METRICS_VIEW = "vw_metricas_qualidade"

# The partition that keeps loads apart, in tables that are published by catalog pointer.
RUN = "load_run"

# --- fixed values: limits --------------------------------------------------------
VENDOR_RANGE = (1, 4)
PASSENGERS_MAX = 9
AMOUNT_MAX = 1000.0
MIN_SECONDS = 60
MAX_SECONDS = 86400
MAX_AGE_DAYS = 3650
MAX_PCT_ERROR = "5.0"
MAX_PCT_TYPE = "0.1"
