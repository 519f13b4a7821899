"""Bring a DataFrame to a declared schema in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripledger.functions.columns import as_flag


class SchemaError(ValueError):
    """The input cannot be brought to the declared schema."""


class EmptyInputError(ValueError):
    """The input holds no rows."""


@dataclass(frozen=True)
class SchemaDiff:
    expected: frozenset[str]
    missing: frozenset[str]
    extra: frozenset[str]


def schema_diff(df: DataFrame, schema: StructType) -> SchemaDiff:
    """Case-sensitive comparison of column names."""
    have, want = frozenset(df.columns), frozenset(schema.names)
    return SchemaDiff(want, want - have, have - want)


def spelling(df: DataFrame, schema: StructType) -> dict[str, str]:
    """Declared name -> name found in the input, matched regardless of case."""
    found: dict[str, list[str]] = {}
    for name in df.columns:
        found.setdefault(name.lower(), []).append(name)
    matches = {}
    for name in schema.names:
        candidates = found.get(name.lower(), [])
        if len(candidates) > 1:
            raise SchemaError(f"columns {candidates} all match {name!r}")
        if candidates:
            matches[name] = candidates[0]
    return matches


def _source(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _convert(column: Column, kind, on_error: str) -> Column:
    if on_error not in ("null", "raise"):
        raise ValueError("on_error must be 'null' or 'raise'")
    return column.try_cast(kind) if on_error == "null" else column.cast(kind)


def normalize_names(df: DataFrame, schema: StructType) -> DataFrame:
    """Rename columns to the declared spelling; nothing is added, dropped or moved."""
    declared = {found: name for name, found in spelling(df, schema).items()}
    return df.select([_source(c).alias(declared.get(c, c)) for c in df.columns])


def add_missing(df: DataFrame, schema: StructType) -> DataFrame:
    """Append each absent declared column as a typed NULL."""
    absent = schema_diff(df, schema).missing
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name in absent]
    return df.select("*", *nulls)


def cast_to(df: DataFrame, schema: StructType, on_error: str = "null") -> DataFrame:
    """Cast the declared columns; a value that does not fit becomes NULL or an error."""
    types = {f.name: f.dataType for f in schema}
    return df.select(
        [_convert(_source(c), types[c], on_error).alias(c) if c in types else _source(c) for c in df.columns]
    )


def reorder(df: DataFrame, schema: StructType) -> DataFrame:
    """Declared columns in declared order; others are left out."""
    return df.select([_source(c) for c in schema.names])


def conform(
    df: DataFrame, schema: StructType, extras: str = "drop", on_error: str = "null",
    flags: dict[str, str] | None = None,
) -> DataFrame:
    """Declared names, types and order in a single projection over the input.

    ``extras="fail"`` rejects columns the schema does not declare. ``on_error="flag"`` makes NULL of a
    value that does not fit, and of ``flags`` (declared column -> flag column) appends which rows had one.
    """
    if on_error == "flag" and not flags:
        raise ValueError("on_error='flag' needs the flags to set")
    lost = []
    for name, flag in (flags or {}).items() if on_error == "flag" else ():
        found = spelling(df, schema).get(name)
        given = _source(found) if found else F.lit(None)
        lost.append(as_flag(given.isNotNull() & given.try_cast(schema[name].dataType).isNull()).alias(flag))
    on_error = "null" if on_error == "flag" else on_error
    matches = spelling(df, schema)
    surplus = sorted(set(df.columns) - set(matches.values()))
    if surplus and extras == "fail":
        raise SchemaError(f"columns not in the schema: {surplus}")
    if extras not in ("drop", "fail"):
        raise ValueError("extras must be 'drop' or 'fail'")
    return df.select(
        [
            (
                _convert(_source(matches[f.name]), f.dataType, on_error)
                if f.name in matches
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in schema
        ]
        + lost
    )


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Raise unless the DataFrame holds a row; Spark stops at the first one."""
    if df.isEmpty():
        raise EmptyInputError(f"{what} holds no rows")
    return df


def schema_report(df: DataFrame, schema: StructType) -> DataFrame:
    """One row per column of either side with its state and its non-null count, in one pass."""
    matches = spelling(df, schema)
    found_as = {found: name for name, found in matches.items()}
    present = [
        (c, found_as.get(c, c), "extra" if c not in found_as else "matched" if found_as[c] == c else "renamed")
        for c in df.columns
    ]
    absent = [(name, name, "missing") for name in schema.names if name not in matches]
    filled = df.agg(*[F.count(_source(c)).alias(f"c{i}") for i, (c, _, _) in enumerate(present)])
    entries = [
        F.struct(F.lit(name).alias("column_name"), F.lit(state).alias("state"), F.col(f"c{i}").alias("filled"))
        for i, (_, name, state) in enumerate(present)
    ] + [
        F.struct(F.lit(name).alias("column_name"), F.lit(state).alias("state"), F.lit(0).cast("bigint").alias("filled"))
        for _, name, state in absent
    ]
    return filled.select(F.inline(F.array(*entries)))
