"""Results as boxed text, JSON lines or Arrow bytes."""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame


def boxed(df: DataFrame, padded_dates: bool = True) -> str:
    """The rows in a box-drawn table; null prints as NULL. All rows come to the caller."""
    return box(df.columns, df.toLocalIterator(), padded_dates)


def box(names: Sequence[str], rows: Iterable[Sequence], padded_dates: bool = True) -> str:
    table = [[*names], *([_cell(v, padded_dates) for v in row] for row in rows)]
    width = [max(len(r[i]) for r in table) for i in range(len(names))]
    line = lambda a, b, c: a + b.join("─" * (w + 2) for w in width) + c
    drawn = ["│" + "│".join(f" {v:<{w}} " for v, w in zip(r, width, strict=True)) + "│" for r in table]
    return "\n".join([line("┌", "┬", "┐"), drawn[0], line("├", "┼", "┤"), *drawn[1:], line("└", "┴", "┘")])


def _cell(value: object, padded_dates: bool) -> str:
    if value is None:
        return "NULL"
    if not padded_dates and hasattr(value, "year"):
        return f"{value.year}-{value.month}-{value.day}"
    return str(value)


def json_lines(df: DataFrame) -> Iterator[str]:
    for row in df.toLocalIterator():
        yield json.dumps(row.asDict(), default=str)


def arrow_bytes(df: DataFrame) -> bytes:
    """Schema and rows as an Arrow IPC stream."""
    table, out = df.toArrow(), io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()
