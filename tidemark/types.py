"""Column types: INT, LONG, DECIMAL (a double), CHAR(n) and DATE, as Spark fields."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import AnalysisError

#: Type ids as system tables list them, and sizes in bytes.
IDS = {"INT": 0, "LONG": 1, "DECIMAL": 2, "CHAR": 3, "DATE": 4}
SIZES = {"INT": 4, "LONG": 8, "DECIMAL": 8, "DATE": 4}
_SPARK = {"INT": T.IntegerType(), "LONG": T.LongType(), "DECIMAL": T.DoubleType(), "CHAR": T.StringType(), "DATE": T.DateType()}


@dataclass(frozen=True)
class ColumnType:
    name: str
    length: int = 0

    @property
    def id(self) -> int:
        return IDS[self.name]

    @property
    def size(self) -> int:
        return self.length if self.name == "CHAR" else SIZES[self.name]

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self.name]

    @property
    def numeric(self) -> bool:
        return self.name in ("INT", "LONG", "DECIMAL")


def field(name: str, kind: ColumnType, nullable: bool = False) -> T.StructField:
    """CHAR(n) is a string whose length stands in the metadata: Spark's own CHAR pads with blanks."""
    return T.StructField(name, kind.spark, nullable, {"char_length": kind.length} if kind.name == "CHAR" else {})


def of_field(f: T.StructField) -> ColumnType:
    return of_spark(f.dataType, (f.metadata or {}).get("char_length", 0))


def of_spark(kind: T.DataType, length: int = 0) -> ColumnType:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return ColumnType("INT")
    if isinstance(kind, T.LongType):
        return ColumnType("LONG")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return ColumnType("DECIMAL")
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return ColumnType("CHAR", length)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return ColumnType("DATE")
    raise AnalysisError(f"no column type for {kind.simpleString()}")


def promoted(a: ColumnType, b: ColumnType) -> ColumnType:
    """Type of arithmetic on a and b: DECIMAL before LONG before INT."""
    if not (a.numeric and b.numeric):
        raise AnalysisError(f"no arithmetic on {a.name} and {b.name}")
    return next(ColumnType(n) for n in ("DECIMAL", "LONG", "INT") if n in (a.name, b.name))


def stored(column: Column, kind: ColumnType) -> Column:
    """`column` as a table keeps it: numbers cast (a DECIMAL into INT or LONG is cut off), CHAR(n) cut to n characters."""
    if kind.name == "CHAR":
        return F.substring(column.cast("string"), 1, kind.length) if kind.length else column.cast("string")
    return column.cast(kind.spark)


@dataclass(frozen=True)
class Literal:
    """A literal with its type and, for quoted digits, the text between the quotes."""

    value: int | float | str | datetime.date
    kind: ColumnType
    text: str | None = None

    def as_type(self, kind: ColumnType) -> Literal:
        """This literal next to a column of `kind`: quoted digits stay text for CHAR; a quoted date does as well."""
        if kind.name == "CHAR" and self.text is not None:
            return Literal(self.text, ColumnType("CHAR", len(self.text)), self.text)
        if kind.name == "CHAR" != self.kind.name or kind.name == "DATE" != self.kind.name or kind.numeric and not self.kind.numeric:
            raise AnalysisError(f"{self.kind.name} literal for a column of type {kind.name}")
        return self

    @property
    def column(self) -> Column:
        if self.kind.name == "LONG":
            return F.lit(self.value).cast("long")
        return F.lit(self.value)
