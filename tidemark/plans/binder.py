"""Binding: names to columns, checks, and the DataFrame of a SELECT with its logical plan.

Inside a query every column has a name of its own (its table's and its own number), so columns of the same name, self
joins and case never mix; the names of the result are given last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AmbiguousColumn, AnalysisError, ColumnNotFound, ColumnNotGrouped, TableNotFound
from ..functions.aggregates import aggregate
from ..functions.scalar import arithmetic, compare
from ..types import ColumnType, of_field
from . import ast
from .parser import COMPARISONS


@dataclass(frozen=True)
class Bound:
    column: Column
    kind: ColumnType


@dataclass(frozen=True)
class Source:
    alias: str
    columns: dict[str, tuple[str, ColumnType]]  # name: (name inside the query, type)


class Scope:
    """Tables that a statement can name, in the order in which a star lists them."""

    def __init__(self, sources: list[Source]):
        self.sources = sources
        if len({s.alias for s in sources}) != len(sources):
            raise AnalysisError("a table name or alias stands twice; give another alias")

    def find(self, name: ast.Name) -> tuple[str, ColumnType]:
        if name.table is not None:
            source = self.source(name.table)
            if name.column not in source.columns:
                raise ColumnNotFound(f"no column {name}")
            return source.columns[name.column]
        found = [s.columns[name.column] for s in self.sources if name.column in s.columns]
        if not found:
            raise ColumnNotFound(f"no column {name}")
        if len(found) > 1:
            raise AmbiguousColumn(f"column {name} is in more than one table")
        return found[0]

    def owner(self, name: ast.Name) -> str:
        """The alias of the table that a name belongs to."""
        inner = self.find(name)[0]
        return next(s.alias for s in self.sources if any(c == inner for c, _ in s.columns.values()))

    def source(self, alias: str) -> Source:
        for s in self.sources:
            if s.alias == alias:
                return s
        raise TableNotFound(f"no table {alias}")

    def star(self, name: ast.Name) -> list[ast.Name]:
        sources = [self.source(name.table)] if name.table else self.sources
        return [ast.Name(c, s.alias) for s in sources for c in s.columns]


def conjuncts(e: ast.Expression | None) -> list[ast.Expression]:
    if isinstance(e, ast.Binary) and e.sign == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [] if e is None else [e]


def operand(e: ast.Expression, scope: Scope) -> Bound:
    """A column, literal or arithmetic without aggregates."""
    if isinstance(e, ast.Name):
        if e.column == "*":
            raise AnalysisError("a star stands for columns, not for a value")
        inner, kind = scope.find(e)
        return Bound(F.col(inner), kind)
    if isinstance(e, ast.Value):
        return Bound(e.literal.column, e.literal.kind)
    if isinstance(e, ast.Binary) and e.sign in "+-*/":
        a, b = operand(e.left, scope), operand(e.right, scope)
        return Bound(*arithmetic(e.sign, a.column, a.kind, b.column, b.kind))
    raise AnalysisError(f"{e} is no value")


def condition(e: ast.Expression, scope: Scope) -> Column:
    if isinstance(e, ast.Binary) and e.sign in ("AND", "OR"):
        a, b = condition(e.left, scope), condition(e.right, scope)
        return a & b if e.sign == "AND" else a | b
    if isinstance(e, ast.Binary) and e.sign in COMPARISONS:
        a, b = operand(e.left, scope), operand(e.right, scope)
        if isinstance(e.right, ast.Value) and not isinstance(e.left, ast.Value):
            b = _as(e.right, a.kind)
        elif isinstance(e.left, ast.Value) and not isinstance(e.right, ast.Value):
            a = _as(e.left, b.kind)
        return compare(e.sign, a.column, a.kind, b.column, b.kind)
    raise AnalysisError(f"{e} is no condition")


def _as(e: ast.Value, kind: ColumnType) -> Bound:
    literal = e.literal.as_type(kind)
    if kind.name == "INT" and isinstance(literal.value, int) and -(1 << 31) <= literal.value < 1 << 31:
        return Bound(F.lit(literal.value).cast("int"), kind)  # so the column needs no cast and the filter reaches the scan
    return Bound(literal.column, ColumnType("CHAR") if literal.kind.name == "CHAR" else literal.kind)


def _aggregates(e: ast.Expression) -> list[ast.Aggregate]:
    if isinstance(e, ast.Aggregate):
        return [e]
    return _aggregates(e.left) + _aggregates(e.right) if isinstance(e, ast.Binary) else []


def _names(e: ast.Expression) -> list[ast.Name]:
    if isinstance(e, ast.Name):
        return [e]
    return _names(e.left) + _names(e.right) if isinstance(e, ast.Binary) else []


def source_of(schema: T.StructType, alias: str, number: int) -> Source:
    return Source(alias, {f.name: (f"c{number}_{i}", of_field(f)) for i, f in enumerate(schema.fields)})


def of_one_table(query: ast.Select, scope: Scope) -> dict[str, ast.Expression | None]:
    """For each alias the conjuncts of WHERE and ON that name this table alone, as one condition without table names; None without any."""
    out: dict[str, ast.Expression | None] = {s.alias: None for s in scope.sources}
    for c in conjuncts(query.where) + [on for _, on in query.joins]:
        owners = {scope.owner(n) for n in _names(c)}
        if len(owners) == 1:
            (alias,) = owners
            out[alias] = bare(c) if out[alias] is None else ast.Binary("AND", out[alias], bare(c))
    return out


def bare(e: ast.Expression) -> ast.Expression:
    """A condition on one table without table names."""
    if isinstance(e, ast.Name):
        return ast.Name(e.column)
    return ast.Binary(e.sign, bare(e.left), bare(e.right)) if isinstance(e, ast.Binary) else e


@dataclass
class Plan:
    """The bound query: its DataFrame, names and types of the result, and the logical plan as nested dicts."""

    df: DataFrame
    names: list[str]
    logical: dict
    tables: list[tuple[str, ast.Expression | None]]  # with the condition that the table is read by


def _node(name: str, output: list[str], *children: dict, data: str | None = None) -> dict:
    out = {"name": name, "output": ",".join(output)}
    return out | ({"data": data} if data is not None else {}) | {"childs": list(children)}


def bind(query: ast.Select, table: Callable[..., DataFrame], strategy: str | None = None, schema: Callable[[str], T.StructType] | None = None) -> Plan:
    """`table` gives a table's DataFrame by name; `strategy` is a join hint or None, with which Catalyst chooses.

    With `schema`, which gives a table's columns by name, `table` is called with the name and a condition, and may leave out rows for which that does not hold.
    """
    listed = [t for t, _ in reversed(query.joins)] + query.tables  # a star lists the table joined last first
    whole = {} if schema else {t.alias: table(t.name) for t in listed}
    sources, nodes = [], {}
    for i, t in enumerate(listed):
        source = source_of(schema(t.name) if schema else whole[t.alias].schema, t.alias, i)
        sources.append(source)
        nodes[t.alias] = _node("TableScan", [f"{t.alias}.{c}" for c in source.columns], data=t.name)
    scope = Scope(sources)
    own = of_one_table(query, scope)
    frames = {}
    for t, source in zip(listed, sources, strict=True):
        df = table(t.name, own[t.alias]) if schema else whole[t.alias]
        frames[t.alias] = df.toDF(*(inner for inner, _ in source.columns.values()))

    first, *others = query.tables
    df, node, seen = frames[first.alias], nodes[first.alias], [first.alias]
    for t in others:
        df, seen = df.crossJoin(frames[t.alias]), [*seen, t.alias]
        node = _node("Cross Product", node["output"].split(",") + nodes[t.alias]["output"].split(","), node, nodes[t.alias])
    for t, on in query.joins:
        seen.append(t.alias)
        scope_now = Scope([s for s in sources if s.alias in seen])
        right = frames[t.alias].hint(strategy) if strategy else frames[t.alias]
        df = df.join(right, condition(on, scope_now), "inner")
        node = _node("Join", nodes[t.alias]["output"].split(",") + node["output"].split(","), nodes[t.alias], node, data=str(on))
    for c in conjuncts(query.where):
        df = df.filter(condition(c, scope))
        node = _node("Selection", node["output"].split(","), node, data=str(c))

    items: list[tuple[ast.Expression, str]] = []
    for e, alias in query.items:
        if isinstance(e, ast.Name) and e.column == "*":
            if alias:
                raise AnalysisError("a star has no alias")
            items += [(n, str(n) if e.table else n.column) for n in scope.star(e)]
        else:
            items.append((e, alias or str(e)))

    made = list(dict.fromkeys(a for e, _ in items for a in _aggregates(e)))
    if made or query.group:
        df, node, output, order = _group(query, df, node, scope, items, made)
    else:
        output = [operand(e, scope).column for e, _ in items]
        order = [(operand(n, scope).column, up) for n, up in query.order]
        for e, _ in items:
            if isinstance(e, ast.Binary):
                node = _node("Arithmetic", [*node["output"].split(","), str(e)], node, data=str(e))
    if order:
        df = df.orderBy(*(c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in order))
        node = _node("Order By", node["output"].split(","), node, data=", ".join(f"{n} {'ASC' if up else 'DESC'}" for n, up in query.order))
    if query.limit is not None:
        df = df.offset(query.offset).limit(query.limit) if query.offset else df.limit(query.limit)
        node = _node("Limit", node["output"].split(","), node, data=f"{query.limit} OFFSET {query.offset}")
    names = [n for _, n in items]
    df = df.select(*(c.alias(n) for c, n in zip(output, names, strict=True)))
    node = _node("Projection", names, node)
    return Plan(df, names, node, [(t.name, own[t.alias]) for t in listed])


def _group(query: ast.Select, df: DataFrame, node: dict, scope: Scope, items: list, made: list[ast.Aggregate]):
    keys = {scope.find(n)[0]: scope.find(n)[1] for n in query.group}
    told: dict[ast.Aggregate, tuple[str, ColumnType]] = {}
    columns = []
    for i, a in enumerate(made):
        if _aggregates(a.of):
            raise AnalysisError("an aggregate inside an aggregate")
        star = isinstance(a.of, ast.Name) and a.of.column == "*"
        if star and a.name != "COUNT":
            raise AnalysisError(f"{a.name}(*) is not there")
        if star and a.of.table:
            scope.source(a.of.table)
        inside = None if star else operand(a.of, scope)
        column, kind = aggregate(a.name, inside and inside.column, inside and inside.kind, bool(keys))
        columns.append(column.alias(f"a{i}"))
        told[a] = f"a{i}", kind
    for n in [n for e, _ in items for n in _names(e)] + [n for n, _ in query.order]:
        if scope.find(n)[0] not in keys:
            raise ColumnNotGrouped(f"column {n} is neither grouped nor aggregated")
    if columns:
        df = df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
    else:
        df = df.select(*keys).distinct()
    node = _node("Aggregation", [*map(str, made), *map(str, query.group)], node, data=", ".join(map(str, query.group)))

    def over(e: ast.Expression) -> Bound:
        if isinstance(e, ast.Aggregate):
            inner, kind = told[e]
            return Bound(F.col(inner), kind)
        if isinstance(e, ast.Binary):
            a, b = over(e.left), over(e.right)
            return Bound(*arithmetic(e.sign, a.column, a.kind, b.column, b.kind))
        return operand(e, scope)

    return df, node, [over(e).column for e, _ in items], [(F.col(scope.find(n)[0]), up) for n, up in query.order]
