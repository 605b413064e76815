"""The system tables, made from a state of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .sources.store import State
from .types import ColumnType, field, of_field

_INT, _LONG, _NAME = ColumnType("INT"), ColumnType("LONG"), ColumnType("CHAR", 48)
#: The system tables and their columns. Index type 1 is the ordered one.
SYSTEM: dict[str, list[tuple[str, ColumnType]]] = {
    "system_tables": [("id", _INT), ("name", _NAME), ("page", _INT), ("time_travel_page", _LONG)],
    "system_columns": [("id", _INT), ("table_id", _INT), ("type_id", _INT), ("length", _INT), ("name", _NAME), ("is_nullable", _INT), ("is_unique", _INT), ("is_primary_key", _INT)],
    "system_indices": [("id", _INT), ("column_id", _INT), ("type_id", _INT), ("name", _NAME), ("is_unique", _INT)],
    "system_table_statistics": [("table_id", _INT), ("cardinality", _LONG)],
}
ORDERED = 1


def schema(name: str) -> T.StructType:
    return T.StructType([field(*c) for c in SYSTEM[name]])


def system_table(spark: SparkSession, state: State, name: str) -> DataFrame:
    tables = sorted(state.tables.items(), key=lambda x: x[1].id)
    if name == "system_tables":
        rows = [(t.id, n[:48], 0, 0) for n, t in tables]  # pages are the file system's
    elif name == "system_columns":
        rows = [(t.column_ids[f.name], t.id, of_field(f).id, of_field(f).size, f.name[:48], int(f.nullable), 0, 0) for _, t in tables for f in t.schema.fields]
    elif name == "system_indices":
        rows = [(i["id"], t.column_ids[i["column"]], ORDERED, i["name"][:48], int(i["unique"])) for _, t in tables for i in t.indices]
    else:
        rows = [(t.id, t.rows) for _, t in tables]
    return spark.createDataFrame(rows, schema(name))
