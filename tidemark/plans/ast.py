"""Syntax tree of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..types import ColumnType, Literal


@dataclass(frozen=True)
class Name:
    """A column; table None if it is written without one, column "*" for all."""

    column: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Binary:
    """Arithmetic, a comparison, AND or OR."""

    sign: str
    left: Expression
    right: Expression

    def __str__(self) -> str:
        return f"({self.left} {self.sign} {self.right})"


@dataclass(frozen=True)
class Aggregate:
    name: str
    of: Expression

    def __str__(self) -> str:
        return f"{self.name}({self.of})"


@dataclass(frozen=True)
class Value:
    literal: Literal

    def __str__(self) -> str:
        return str(self.literal.value)


Expression = Name | Binary | Aggregate | Value


@dataclass(frozen=True)
class Table:
    name: str
    alias: str


@dataclass(frozen=True)
class Select:
    items: list[tuple[Expression, str | None]]
    tables: list[Table]
    joins: list[tuple[Table, Binary]] = field(default_factory=list)
    where: Expression | None = None
    group: list[Name] = field(default_factory=list)
    order: list[tuple[Name, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: list[tuple[str, ColumnType, bool]]
    if_not_exists: bool = False


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    unique: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: list[str]
    rows: list[list[Literal]]


@dataclass(frozen=True)
class Update:
    table: str
    changes: list[tuple[str, Expression]]
    where: Expression | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expression | None = None


@dataclass(frozen=True)
class Transaction:
    action: str


Statement = Select | CreateTable | CreateIndex | Insert | Update | Delete | Transaction
