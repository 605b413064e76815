"""A SELECT of the dialect over a streaming DataFrame: the same operators, planned by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import AnalysisError
from ..plans import ast
from ..plans.binder import bind
from ..plans.parser import parse


def select_stream(text: str, **tables: DataFrame) -> DataFrame:
    """The query over `tables`, streaming or not. A sort needs an aggregation and complete output, as Spark asks for; OFFSET is not there."""
    query = parse(text)
    if not isinstance(query, ast.Select):
        raise AnalysisError("only a SELECT runs over a stream")
    if query.offset or query.order and not query.group and any(df.isStreaming for df in tables.values()):
        raise AnalysisError("a stream has no end to sort or skip by")
    return bind(query, lambda name: tables[name]).df
