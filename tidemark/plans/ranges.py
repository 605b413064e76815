"""Which files a condition can hold for, told by the least and greatest values that the log keeps of their indexed columns."""

from __future__ import annotations

import datetime

from pyspark.sql import types as T

from ..errors import AnalysisError
from ..types import of_field
from . import ast

#: The same comparison with its sides exchanged.
_TURNED = {"=": "=", "!=": "!=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def kept(value: object) -> object:
    """A least or greatest value as the log keeps it."""
    return value.isoformat() if isinstance(value, datetime.date) else value


def may_hold(e: ast.Expression | None, schema: T.StructType, ranges: dict[str, list]) -> bool:
    """False only if `e` holds for no row whose columns lie in `ranges` (column: least, greatest; null where all is null); names of tables do not matter."""
    if not isinstance(e, ast.Binary):
        return True
    if e.sign == "AND":
        return may_hold(e.left, schema, ranges) and may_hold(e.right, schema, ranges)
    if e.sign == "OR":
        return may_hold(e.left, schema, ranges) or may_hold(e.right, schema, ranges)
    if isinstance(e.left, ast.Value) and isinstance(e.right, ast.Name) and e.sign in _TURNED:
        return may_hold(ast.Binary(_TURNED[e.sign], e.right, e.left), schema, ranges)
    if not (isinstance(e.left, ast.Name) and isinstance(e.right, ast.Value) and e.sign in _TURNED and e.left.column in ranges):
        return True
    least, greatest = ranges[e.left.column]
    if least is None:
        return False  # nulls alone, and a comparison with null does not hold
    try:
        value = kept(e.right.literal.as_type(of_field(schema[e.left.column])).value)
        if isinstance(value, str) != isinstance(least, str) or isinstance(value, (int, float)) and max(abs(value), abs(least), abs(greatest)) >= 2**53:
            return True  # numbers that Spark may round before it compares them
        return {
            "=": least <= value <= greatest, "!=": not least == value == greatest, "<>": not least == value == greatest,
            "<": least < value, "<=": least <= value, ">": greatest > value, ">=": greatest >= value,
        }[e.sign]
    except (AnalysisError, TypeError):
        return True
