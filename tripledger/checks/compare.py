"""Compare registered queries with their SQL: ``python -m tripledger.checks.compare SF_DIR [KEY ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from tripledger.checks.oracle import oracle_sql
from tripledger.checks.queries import QUERIES
from tripledger.session import local_session

TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return None if value is None else str(value)


def _multiset(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, key: str, sf_dir: str) -> str:
    """Empty text if names and all values agree, else what differs."""
    df = QUERIES[key](spark, sf_dir)
    found = _multiset(df.columns, df.collect())
    result = con.execute(oracle_sql()[key])
    names = [c[0] for c in result.description]
    wanted = _multiset(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {c[0]: TYPES.get(str(c[1]), str(c[1])) for c in result.description}
    if dict(df.dtypes) != kinds:
        return f"types differ: {sorted(set(df.dtypes) ^ set(kinds.items()))}"
    if found != wanted:
        return (
            f"{sum(found.values())} rows against {sum(wanted.values())}; "
            f"surplus {list((found - wanted).items())[:2]}; lacking {list((wanted - found).items())[:2]}"
        )
    return ""


def main(sf_dir: str, keys: list[str]) -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(sf_dir)
    wrong = 0
    for key in keys or list(QUERIES):
        began = time.time()
        try:
            text = difference(spark, con, key, sf_dir)
        except Exception as error:
            text = f"{type(error).__name__}: {str(error)[:600]}"
        wrong += bool(text)
        print(f"{'DIFF' if text else 'ok  '} {key} {time.time() - began:.2f}s {text}", flush=True)
    print(f"{wrong} of {len(keys or QUERIES)} differ")
    return 1 if wrong else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
