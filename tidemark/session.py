"""A session: statements and commands in, DataFrames out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalog
from .commands import run_command
from .config import Config
from .errors import AnalysisError, ColumnCannotBeNull, ColumnNotFound, EngineError, NotInTransaction
from .operators.relational import values
from .plans import ast
from .plans.binder import Plan, Scope, Source, bare, bind, condition, operand
from .plans.parser import parse
from .sources.loader import read_tbl, statements, table_of
from .sources.store import Store, TableState
from .transactions import Transaction
from .types import Literal, field, of_field, stored


@dataclass
class Statistics:
    """Of the last statement: a SELECT's rows and execution time are known when its rows have been given out (`each`)."""

    planning_ms: float = 0.0
    rows: int = 0
    execution_ms: float = 0.0
    note: str = ""


class Session:
    """Executes statements of the dialect over a store's tables and over views of any DataFrame.

    A statement outside BEGIN ... COMMIT is a transaction of its own. As a context manager, a session aborts what is open at its end.
    """

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.store, self.config = spark, Store(spark, warehouse), Config(spark)
        self.open: Transaction | None = None
        self.views: dict[str, DataFrame] = {}
        self.last = Statistics()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.open = None

    # ---- API

    def execute(self, text: str) -> DataFrame | None:
        """Runs a statement or a `:command`; rows as a DataFrame, None if there are none to give."""
        if text.lstrip().startswith(":"):
            self.last = Statistics()
            return run_command(self, text.strip())
        statement = parse(text, bool(self.config["flat_precedence"]))
        if isinstance(statement, ast.Transaction):
            return self._transaction(statement.action)
        if isinstance(statement, ast.Select):
            return self._select(statement)
        began = time.perf_counter()
        self._in_transaction(lambda t: getattr(self, f"_{type(statement).__name__.lower()}")(t, statement))
        self.last.execution_ms = (time.perf_counter() - began) * 1000
        return None

    def each(self, text: str, on_row: Callable[[Row], None], on_schema: Callable[[T.StructType], None] | None = None) -> int:
        """Gives each result row to `on_row`, partition by partition; how many there were."""
        df = self.execute(text)
        return 0 if df is None else self.give(df, on_row, on_schema)

    def give(self, df: DataFrame, on_row: Callable[[Row], None], on_schema: Callable[[T.StructType], None] | None = None) -> int:
        """Gives each row of a statement's result to `on_row`, and notes their number and the time that it took."""
        if on_schema:
            on_schema(df.schema)
        n, began = 0, time.perf_counter()
        for row in df.toLocalIterator():
            on_row(row)
            n += 1
        self.last.rows, self.last.execution_ms = n, (time.perf_counter() - began) * 1000
        return n

    def view(self, name: str, df: DataFrame) -> None:
        """Makes `df` readable as a table that cannot be changed."""
        self.views[name] = df

    def create_from(self, name: str, df: DataFrame) -> None:
        """A table with the columns and rows of `df`."""

        def run(t: Transaction) -> None:
            fields = [field(f.name, of_field(f), True) for f in df.schema.fields]
            t.create(name, T.StructType(fields))
            t.insert(name, df.select(*(stored(F.col(f"`{f.name}`"), of_field(f)).alias(f.name) for f in fields)))

        self._in_transaction(run)

    def load(self, path: str) -> None:
        """Runs a `.sql` script as one transaction, or inserts a `.tbl` file into the table of its name."""
        if path.endswith(".sql"):
            text = "\n".join(r["value"] for r in self.spark.read.text(path, wholetext=True).collect())
            self._in_transaction(lambda _: [self.execute(s) for s in statements(text)])
        elif path.endswith(".tbl"):

            def run(t: Transaction) -> None:
                name = table_of(path)
                self.last = Statistics(rows=t.insert(name, read_tbl(self.spark, path, t.table(name).schema)))
                self._unique(t, name)

            self._in_transaction(run)
        else:
            raise EngineError(f"cannot load {path}")

    def compact(self, name: str, files: int) -> None:
        """Rewrites a table's files as `files` files."""

        def run(t: Transaction) -> None:
            rows, indices = t.frame(name), t.table(name).indices
            t.replace(name, rows.repartitionByRange(files, F.col(f"`{indices[0]['column']}`")) if indices else rows.repartition(files))

        self._in_transaction(run)

    def plan(self, text: str) -> Plan:
        statement = parse(text, bool(self.config["flat_precedence"]))
        if not isinstance(statement, ast.Select):
            raise AnalysisError("only a SELECT has a plan to show")
        return self._bound(statement, self.open or Transaction(self.store))

    # ---- transactions

    def _transaction(self, action: str) -> None:
        if action == "BEGIN":
            if self.open:
                raise EngineError("a transaction is open already")
            self.open = Transaction(self.store)
            return
        if not self.open:
            raise NotInTransaction("no transaction is open")
        t, self.open = self.open, None
        if action == "COMMIT":
            t.commit(self._holds)

    def _in_transaction(self, work: Callable[[Transaction], object]) -> None:
        if self.open:
            work(self.open)
            return
        self.open = t = Transaction(self.store)
        try:
            work(t)
        finally:
            self.open = None
        t.commit(self._holds)

    def _holds(self, table: TableState, where: ast.Expression) -> Column:
        return F.coalesce(condition(bare(where), self._scope("", table.schema)), F.lit(False))

    # ---- statements

    def _bound(self, query: ast.Select, t: Transaction) -> Plan:
        def schema(name: str) -> T.StructType:
            if name in self.views:
                return self.views[name].schema
            return catalog.schema(name) if name in catalog.SYSTEM else t.table(name).schema

        def table(name: str, where: ast.Expression | None) -> DataFrame:
            if name in self.views:
                return self.views[name]
            if name in catalog.SYSTEM:
                return catalog.system_table(self.spark, t.state, name)
            return t.frame(name, None if self.config["no_optimization"] else where)

        plan = bind(query, table, self.config.join_strategy, schema)
        if self.config["check_final_plan"]:
            plan.df._jdf.queryExecution().executedPlan()  # planned now, so that what cannot be planned fails here
        return plan

    def _select(self, query: ast.Select) -> DataFrame:
        began = time.perf_counter()
        t = self.open or Transaction(self.store)
        plan = self._bound(query, t)
        for name, where in plan.tables:
            if name in t.state.tables:
                t.read(name, where)
        self.last = Statistics((time.perf_counter() - began) * 1000)
        return plan.df

    @staticmethod
    def _scope(name: str, schema: T.StructType) -> Scope:
        return Scope([Source(name, {f.name: (f"`{f.name}`", of_field(f)) for f in schema.fields})])

    def _createtable(self, t: Transaction, s: ast.CreateTable) -> None:
        names = [n for n, _, _ in s.columns]
        if len({n.lower() for n in names}) != len(names):  # Parquet columns that differ in case alone cannot be told apart
            raise AnalysisError("a column name stands twice")
        if s.if_not_exists and (s.name in t.state.tables or s.name in catalog.SYSTEM):
            return
        if s.name in catalog.SYSTEM or s.name in self.views:
            raise AnalysisError(f"{s.name} is taken")
        t.create(s.name, T.StructType([field(*c) for c in s.columns]))

    def _createindex(self, t: Transaction, s: ast.CreateIndex) -> None:
        if s.column not in t.table(s.table).schema.names:
            raise ColumnNotFound(f"no column {s.column} in {s.table}")
        t.index(s.name, s.table, s.column, s.unique)
        self._unique(t, s.table, whole=True)

    def _insert(self, t: Transaction, s: ast.Insert) -> None:
        schema = t.table(s.table).schema
        names = s.columns or schema.names
        if unknown := [n for n in names if n not in schema.names]:
            raise ColumnNotFound(f"no column {unknown[0]} in {s.table}")
        if missing := [n for n in schema.names if n not in names]:
            raise ColumnCannotBeNull(f"column {missing[0]} has no value")
        if len(set(names)) != len(names) or any(len(r) != len(names) for r in s.rows):
            raise AnalysisError("names and values differ in number")
        at = [names.index(f.name) for f in schema.fields]
        rows = [tuple(_kept(r[i], f) for i, f in zip(at, schema.fields, strict=True)) for r in s.rows]
        self.last = Statistics(rows=t.insert(s.table, values(self.spark, rows, schema).coalesce(1)))
        self._unique(t, s.table)

    def _update(self, t: Transaction, s: ast.Update) -> None:
        table = t.table(s.table)
        scope = self._scope(s.table, table.schema)
        where = self._where(s.where, scope)
        changes = {}
        for name, e in s.changes:
            if name not in table.schema.names:
                raise ColumnNotFound(f"no column {name} in {s.table}")
            kind = of_field(table.schema[name])
            value = e.literal.as_type(kind).column if isinstance(e, ast.Value) else operand(e, scope).column
            changes[name] = stored(value, kind)
        new = lambda df: df.select(*(F.when(where, changes[f.name]).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in changes else F.col(f"`{f.name}`") for f in table.schema.fields))
        t.read(s.table, s.where)
        self.last = Statistics(rows=t.rewrite(s.table, where, new, s.where))
        self._unique(t, s.table)

    def _delete(self, t: Transaction, s: ast.Delete) -> None:
        where = self._where(s.where, self._scope(s.table, t.table(s.table).schema))
        t.read(s.table, s.where)
        self.last = Statistics(rows=t.rewrite(s.table, where, lambda df: df.filter(~where), s.where))

    @staticmethod
    def _where(where: ast.Expression | None, scope: Scope) -> Column:
        return F.lit(True) if where is None else F.coalesce(condition(where, scope), F.lit(False))

    def _unique(self, t: Transaction, table: str, whole: bool = False) -> None:
        if self.config["enforce_unique"]:
            t.check_unique(table, whole)


def _kept(literal: Literal, f: T.StructField) -> object:
    """A literal's value as a row of a table holds it."""
    kind = of_field(f)
    if kind.name == "DATE" and literal.kind.name == "CHAR" or kind.numeric and literal.kind.name in ("CHAR", "DATE") or kind.name == "CHAR" and literal.text is None:
        raise AnalysisError(f"{literal.kind.name} literal for column {f.name} of type {kind.name}")
    if kind.name == "DATE" and literal.kind.name != "DATE":
        raise AnalysisError(f"{literal.kind.name} literal for column {f.name} of type DATE")
    if kind.name == "CHAR":
        return literal.text[: kind.length]
    return float(literal.value) if kind.name == "DECIMAL" else int(literal.value) if kind.numeric else literal.value


