"""Tables in the shared working folder, for queries that exercise a writer."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tripledger.session import work_folder
from tripledger.sources import tables


@dataclass(frozen=True)
class Lake:
    """A schema whose tables keep their files below one folder."""

    spark: SparkSession
    schema: str
    folder: str

    def name(self, table: str) -> str:
        return f"{self.schema}.{table}"

    def place(self, table: str) -> str:
        return f"{self.folder}/tables/{table}"

    def raw(self) -> str:
        tables.create_raw(self.spark, self.name("raw"), self.place("raw"))
        return self.name("raw")

    def staging(self) -> str:
        tables.create_staging(self.spark, self.name("staging"), self.place("staging"))
        return self.name("staging")

    def trusted(self, **options) -> str:
        tables.create_trusted(self.spark, self.name("trusted"), self.place("trusted"), **options)
        return self.name("trusted")

    def quarantine(self, pack: str = "coded", **options) -> str:
        tables.create_quarantine(self.spark, self.name("quarantine"), pack, self.place("quarantine"), **options)
        return self.name("quarantine")

    def files(self, table: str) -> DataFrame:
        """The stored rows, readable after the schema is gone."""
        schema = self.spark.table(self.name(table)).schema
        return self.spark.read.schema(schema).parquet(self.place(table))


    def shown(self, table: str) -> DataFrame:
        """A copy of the rows that the catalog shows, wherever its partitions lie; readable after the schema is gone."""
        rows = self.spark.table(self.name(table))
        copy = f"{self.folder}/shown/{table}"
        rows.write.parquet(copy)
        return self.spark.read.schema(rows.schema).parquet(copy)


@contextmanager
def lake(spark: SparkSession) -> Iterator[Lake]:
    """The catalog entries go at the end; the files stay until the session ends."""
    folder = work_folder(spark, "lake")
    schema = f"tripledger_{uuid.uuid4().hex[:12]}"
    tables.create_schema(spark, schema, "scratch", f"{folder}/schema")
    try:
        yield Lake(spark, schema, folder)
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {schema} CASCADE")
