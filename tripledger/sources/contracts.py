"""Declared schemas of the raw, staging, trusted and quarantine tables."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from tripledger import names as n

# --- fixed values: the raw table, in column order (name, type, meaning) ----------
RAW_COLUMNS = [
    ("VendorID", "bigint", "provider of the record"),
    ("tpep_pickup_datetime", "timestamp", "meter switched on"),
    ("tpep_dropoff_datetime", "timestamp", "meter switched off"),
    ("passenger_count", "double", "passengers, as entered by the driver"),
    ("trip_distance", "double", "miles by the meter"),
    ("RatecodeID", "double", "final rate code: 1-6, 99 unknown"),
    ("store_and_fwd_flag", "string", "Y if held in the vehicle before sending, else N"),
    ("PULocationID", "bigint", "zone of pickup"),
    ("DOLocationID", "bigint", "zone of dropoff"),
    ("payment_type", "bigint", "payment code: 0-6"),
    ("fare_amount", "double", "time-and-distance fare"),
    ("extra", "double", "extras and surcharges"),
    ("mta_tax", "double", "tax triggered by the metered rate"),
    ("tip_amount", "double", "card tips; cash tips are not recorded"),
    ("tolls_amount", "double", "tolls paid"),
    ("improvement_surcharge", "double", "surcharge at flag drop"),
    ("total_amount", "double", "total charged, without cash tips"),
    ("congestion_surcharge", "double", "congestion surcharge"),
    ("airport_fee", "double", "airport pickup fee"),
    ("date_reference", "date", "first day of the month the file covers"),
    ("insertion_date", "date", "day the rows were loaded"),
]

# --- fixed values: the trusted table and what staging adds to it -----------------
TRUSTED_COLUMNS = [
    ("vendor_id", "bigint", "provider of the record"),
    ("tpep_pickup_datetime", "timestamp", "meter switched on"),
    ("tpep_dropoff_datetime", "timestamp", "meter switched off"),
    ("passenger_count", "int", "passengers, as entered by the driver"),
    ("total_amount", "double", "total charged, without cash tips"),
]
STAGING_COLUMNS = TRUSTED_COLUMNS + [
    ("date_reference", "date", "first day of the month the file covers"),
    ("insertion_date", "date", "day the rows were loaded"),
]


TYPES = {
    "bigint": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "string": StringType(),
    "date": DateType(),
    "timestamp": TimestampType(),
}


def struct(columns: list[tuple[str, str, str]]) -> StructType:
    return StructType(
        [
            StructField(name, TYPES[kind], True, {"comment": meaning} if meaning else {})
            for name, kind, meaning in columns
        ]
    )


def raw_schema() -> StructType:
    return struct(RAW_COLUMNS)


def trusted_schema() -> StructType:
    return struct(TRUSTED_COLUMNS)


def staging_schema() -> StructType:
    return struct(STAGING_COLUMNS)


def quarantine_schema(flags: list[str]) -> StructType:
    """Staging columns, one flag per rule, the verdict and the quarantine stamps."""
    return struct(
        STAGING_COLUMNS
        + [(flag, "int", "") for flag in flags]
        + [
            (n.VERDICT, "int", "1 if any check failed"),
            (n.STAMP, "timestamp", "moment of quarantine"),
            (n.REASONS, "string", "labels of the failed rules"),
            (n.ERROR_CLASS, "string", "class of the error"),
            (n.QUARANTINE_DAY, "date", "day of quarantine"),
        ]
    )
