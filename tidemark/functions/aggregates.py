"""COUNT, SUM, AVG, MIN and MAX."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..types import ColumnType

NAMES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def count_rows() -> Column:
    return F.count(F.lit(1))


def aggregate(name: str, column: Column | None, kind: ColumnType | None, grouped: bool) -> tuple[Column, ColumnType]:
    """An aggregate and its type; `column` None counts rows. Over no rows, ungrouped: COUNT and SUM 0, AVG NaN, MIN and MAX null."""
    if name == "COUNT":
        return (count_rows() if column is None else F.count(column)), ColumnType("LONG")
    if column is None:
        raise AnalysisError(f"{name} needs a column")
    if name in ("MIN", "MAX"):
        return (F.min if name == "MIN" else F.max)(column), kind
    if not kind.numeric:
        raise AnalysisError(f"no {name} of {kind.name}")
    if name == "SUM":
        out = F.sum(column)
        wide = ColumnType("DECIMAL") if kind.name == "DECIMAL" else ColumnType("LONG")
        return (out if grouped else F.coalesce(out, F.lit(0).cast(wide.spark))), wide
    out = F.avg(column)
    return (out if grouped else F.coalesce(out, F.lit(float("nan")))), ColumnType("DECIMAL")
