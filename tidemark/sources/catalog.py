"""Names, oids and column types of the tables an engine knows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.types import from_spark

SCHEMA, SCHEMA_OID = "main", 1


@dataclass
class TableEntry:
    name: str
    oid: int
    columns: list[tuple[str, str]]  # name, logical type
    view: bool


@dataclass
class Catalog:
    """The one schema of an engine; table names are unique whatever their case."""

    spark: SparkSession
    tables: dict[str, TableEntry] = field(default_factory=dict)
    _next: int = SCHEMA_OID + 1

    def add(self, name: str, columns: list[tuple[str, str]], *, view: bool, replace: bool = False) -> TableEntry:
        key = name.lower()
        if key in self.tables and not replace:
            raise ValueError(f"table {name} already exists")
        self.tables[key] = TableEntry(name, self._next, columns, view)
        self._next += 1
        return self.tables[key]

    def get(self, name: str) -> TableEntry:
        try:
            return self.tables[name.lower()]
        except KeyError:
            raise ValueError(f"table {name} does not exist") from None

    def remove(self, name: str) -> None:
        self.tables.pop(name.lower(), None)

    @staticmethod
    def columns_of(df: DataFrame) -> list[tuple[str, str]]:
        return [(f.name, from_spark(f.dataType)) for f in df.schema.fields]

    def query_tables(self) -> DataFrame:
        rows = [(SCHEMA, SCHEMA_OID, t.name, t.oid) for t in self.tables.values()]
        return self.spark.createDataFrame(rows, "schema_name string, schema_oid int, table_name string, table_oid int")

    def query_columns(self) -> DataFrame:
        def listed(xs) -> str:
            return "[" + ", ".join(xs) + "]"

        rows = [(t.name, listed(c for c, _ in t.columns), listed(k for _, k in t.columns)) for t in self.tables.values()]
        return self.spark.createDataFrame(rows, "table_name string, column_names string, column_types string")
