"""Arithmetic and comparisons."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..types import ColumnType, promoted


def divide_whole(a: Column, b: Column) -> Column:
    """Integer division that cuts towards zero and fails on zero."""
    return F.call_function("div", a, b)


def arithmetic(sign: str, a: Column, ta: ColumnType, b: Column, tb: ColumnType) -> tuple[Column, ColumnType]:
    """a + b, a - b, a * b or a / b in the promoted type; division of whole numbers stays whole."""
    kind = promoted(ta, tb)
    a, b = a.cast(kind.spark), b.cast(kind.spark)
    if sign == "/":
        out = a / b if kind.name == "DECIMAL" else divide_whole(a, b)
    else:
        out = {"+": operator.add, "-": operator.sub, "*": operator.mul}[sign](a, b)
    return out.cast(kind.spark), kind


COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def compare(sign: str, a: Column, ta: ColumnType, b: Column, tb: ColumnType) -> Column:
    """A comparison; numbers of different types meet in the wider one, other types only their own."""
    if ta.numeric and tb.numeric:
        kind = promoted(ta, tb)
        # a plain column keeps its type where it can, so that the predicate reaches the file scan
        return COMPARE[sign](a if ta == kind else a.cast(kind.spark), b if tb == kind else b.cast(kind.spark))
    if ta.name != tb.name:
        raise AnalysisError(f"cannot compare {ta.name} with {tb.name}")
    return COMPARE[sign](a, b)
