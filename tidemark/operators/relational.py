"""Scan, projection, selection, joins, aggregation, order, limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..types import of_spark


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet table `name`, only `columns` if any are given; filters and columns reach the file scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def values(spark: SparkSession, rows: Sequence[tuple], schema) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(list(rows), schema)


def project(df: DataFrame, **named: Column) -> DataFrame:
    return df.select(*(c.alias(n) for n, c in named.items()))


def extend(df: DataFrame, name: str, column: Column) -> DataFrame:
    """All columns and one computed one."""
    return df.withColumn(name, column)


def select(df: DataFrame, *conjuncts: Column) -> DataFrame:
    for c in conjuncts:
        df = df.filter(c)
    return df


def join(left: DataFrame, right: DataFrame, on: Column, strategy: str | None = None) -> DataFrame:
    """Inner join on any predicate. `strategy` None leaves the choice to Catalyst and its size estimates; else a hint: merge, shuffle_hash."""
    return left.join(right.hint(strategy) if strategy else right, on, "inner")


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def group(df: DataFrame, keys: Sequence[str], **named: tuple[str, Column | None]) -> DataFrame:
    """Grouped aggregates, each given as (name, column): keys first, then aggregates; without aggregates the distinct keys.

    Without keys there is one row also for no input. Partial sums are made before the shuffle.
    """
    if not named:
        return df.select(*keys).distinct()
    told = []
    for alias, (name, column) in named.items():
        kind = None if column is None else of_spark(df.select(column).schema[0].dataType)
        told.append(aggregate(name, column, kind, bool(keys))[0].alias(alias))
    return df.groupBy(*keys).agg(*told) if keys else df.agg(*told)


def order(df: DataFrame, *keys: tuple[str | Column, bool]) -> DataFrame:
    """Sort by (column, ascending); nulls are the least."""
    cols = [F.col(c) if isinstance(c, str) else c for c, _ in keys]
    return df.orderBy(*(c.asc_nulls_first() if up else c.desc_nulls_last() for c, (_, up) in zip(cols, keys, strict=True)))


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(n) if offset else df.limit(n)
