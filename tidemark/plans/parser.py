"""Recursive-descent parser of the dialect.

Keywords are case-insensitive, names are not. A name in back quotes may be a keyword. Precedence is that of standard SQL;
with `flat` all of AND OR + - * / bind alike and to the left.
"""

from __future__ import annotations

import datetime
import re

from ..errors import ParseError
from ..types import ColumnType, Literal
from . import ast

KEYWORDS = frozenset(
    "CREATE TABLE INDEX IF NOT EXISTS ON UNIQUE INSERT INTO VALUES UPDATE SET DELETE NULL INT INTEGER LONG DATE DECIMAL CHAR SELECT FROM AS JOIN WHERE AND OR "
    "COUNT SUM AVG MIN MAX GROUP ORDER BY ASC DESC LIMIT OFFSET BEGIN COMMIT ABORT".split()
)
TOKEN = re.compile(
    r"""\s*(?:(?P<string>'[^']+')|(?P<decimal>\d+\.\d*|\.\d+)|(?P<integer>\d+)|(?P<quoted>`[^`]+`)|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<sign><>|!=|<=|>=|[(),.=<>+\-*/;]))"""
)
DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected character at {at}: {text[at:at + 10].strip()!r}")
        kind, value, at = m.lastgroup, m[m.lastgroup], m.end()
        if kind == "word" and value.upper() in KEYWORDS:
            kind, value = "keyword", value.upper()
        out.append((kind, "<>" if value == "!=" else value.strip("`") if kind == "quoted" else value))
    while out and out[-1] == ("sign", ";"):
        out.pop()
    return out + [("end", "")]


def date(text: str) -> Literal:
    try:
        return Literal(datetime.date.fromisoformat(text), ColumnType("DATE"), text)
    except ValueError as e:
        raise ParseError(f"no date: {text}") from e


class Parser:
    def __init__(self, text: str, flat: bool = False):
        self.tokens, self.at, self.flat = tokens(text), 0, flat

    # ---- tokens

    def peek(self, *values: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind in ("keyword", "sign") and value in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, *values: str) -> str:
        if (value := self.take(*values)) is None:
            raise ParseError(f"expected {' or '.join(values)} before {self.tokens[self.at][1] or 'the end'!r}")
        return value

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind not in ("word", "quoted"):
            raise ParseError(f"expected a name before {value or 'the end'!r}")
        self.at += 1
        return value

    def number(self) -> int:
        kind, value = self.tokens[self.at]
        if kind != "integer":
            raise ParseError(f"expected a number before {value or 'the end'!r}")
        self.at += 1
        return int(value)

    def several(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    # ---- statements

    def statement(self) -> ast.Statement:
        first = self.need("SELECT", "CREATE", "INSERT", "UPDATE", "DELETE", "BEGIN", "COMMIT", "ABORT")
        out = ast.Transaction(first) if first in ("BEGIN", "COMMIT", "ABORT") else getattr(self, first.lower())()
        if self.tokens[self.at][0] != "end":
            raise ParseError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def select(self) -> ast.Select:
        items = self.several(self.item)
        self.need("FROM")
        tables, joins = self.several(self.table), []
        while self.take("JOIN"):
            table = self.table()
            self.need("ON")
            left = self.reference()
            self.need("=")
            joins.append((table, ast.Binary("=", left, self.reference())))
        where = self.where()
        group = self.by("GROUP", self.reference)
        order = self.by("ORDER", self.order_item)
        limit, offset = None, 0
        if self.take("LIMIT"):
            limit = self.number()
            offset = self.number() if self.take("OFFSET") else 0
        return ast.Select(items, tables, joins, where, group, order, limit, offset)

    def by(self, word: str, one) -> list:
        if not self.take(word):
            return []
        self.need("BY")
        return self.several(one)

    def item(self) -> tuple[ast.Expression, str | None]:
        expression = self.sum(self.attribute)
        return expression, self.name() if self.take("AS") else None

    def table(self) -> ast.Table:
        name = self.name()
        alias = self.name() if self.take("AS") or self.tokens[self.at][0] in ("word", "quoted") else name
        return ast.Table(name, alias)

    def order_item(self) -> tuple[ast.Name, bool]:
        return self.reference(), self.take("ASC", "DESC") != "DESC"

    def where(self) -> ast.Expression | None:
        return self.condition() if self.take("WHERE") else None

    def create(self) -> ast.Statement:
        if self.take("TABLE"):
            quiet = bool(self.take("IF"))
            if quiet:
                self.need("NOT")
                self.need("EXISTS")
            name = self.name()
            self.need("(")
            columns = self.several(self.column)
            self.need(")")
            return ast.CreateTable(name, columns, quiet)
        unique = bool(self.take("UNIQUE"))
        self.need("INDEX")
        name = self.name()
        self.need("ON")
        table = self.name()
        self.need("(")
        column = self.name()
        self.need(")")
        return ast.CreateIndex(name, table, column, unique)

    def column(self) -> tuple[str, ColumnType, bool]:
        name = self.name()
        kind = {"INTEGER": "INT"}.get(k := self.need("INT", "INTEGER", "LONG", "DATE", "DECIMAL", "CHAR"), k)
        length = 0
        if kind == "CHAR":
            self.need("(")
            length = self.number()
            self.need(")")
        if self.take("NOT"):
            self.need("NULL")
            return name, ColumnType(kind, length), False
        return name, ColumnType(kind, length), bool(self.take("NULL"))

    def insert(self) -> ast.Insert:
        self.need("INTO")
        table, columns = self.name(), []
        if self.take("("):
            columns = self.several(self.name)
            self.need(")")
        self.need("VALUES")
        return ast.Insert(table, columns, self.several(self.row))

    def row(self) -> list[Literal]:
        self.need("(")
        out = self.several(self.literal)
        self.need(")")
        return out

    def update(self) -> ast.Update:
        table = self.name()
        self.need("SET")
        return ast.Update(table, self.several(self.change), self.where())

    def change(self) -> tuple[str, ast.Expression]:
        column = self.name()
        self.need("=")
        return column, self.sum(self.operand)

    def delete(self) -> ast.Delete:
        self.need("FROM")
        return ast.Delete(self.name(), self.where())

    # ---- expressions

    def reference(self) -> ast.Name:
        name = self.name()
        return ast.Name(self.name(), name) if self.take(".") else ast.Name(name)

    def literal(self) -> Literal:
        negative = bool(self.take("-"))
        if not negative and self.take("DATE"):
            kind, value = self.tokens[self.at]
            if kind != "string":
                raise ParseError("expected a date")
            self.at += 1
            return date(value[1:-1])
        kind, value = self.tokens[self.at]
        if kind not in ("integer", "decimal", "string") or negative and kind == "string":
            raise ParseError(f"expected a value before {value or 'the end'!r}")
        self.at += 1
        sign = -1 if negative else 1
        if kind == "integer":
            return Literal(sign * int(value), ColumnType("LONG"))
        if kind == "decimal":
            return Literal(sign * float(value), ColumnType("DECIMAL"))
        text = value[1:-1]
        if DATE.fullmatch(text):
            return date(text)
        return Literal(int(text), ColumnType("LONG"), text) if re.fullmatch("[0-9]+", text) else Literal(text, ColumnType("CHAR", len(text)), text)

    def sum(self, one) -> ast.Expression:
        if self.flat:
            return self.chain(("+", "-", "*", "/"), one)
        return self.chain(("+", "-"), lambda: self.chain(("*", "/"), one))

    def chain(self, signs: tuple[str, ...], one) -> ast.Expression:
        out = one()
        while sign := self.take(*signs):
            out = ast.Binary(sign, out, one())
        return out

    def attribute(self) -> ast.Expression:
        """An operand of the select list: also stars and aggregates."""
        if self.take("("):
            out = self.sum(self.attribute)
            self.need(")")
            return out
        if self.take("*"):
            return ast.Name("*")
        if self.peek(*AGGREGATES):
            name = self.need(*AGGREGATES)
            self.need("(")
            out = ast.Aggregate(name, self.sum(self.attribute))
            self.need(")")
            return out
        if self.tokens[self.at][0] in ("integer", "decimal", "string") or self.peek("-", "DATE"):
            return ast.Value(self.literal())
        name = self.name()
        if self.take("."):
            return ast.Name("*" if self.take("*") else self.name(), name)
        return ast.Name(name)

    def operand(self) -> ast.Expression:
        if self.take("("):
            out = self.sum(self.operand)
            self.need(")")
            return out
        return self.reference() if self.tokens[self.at][0] in ("word", "quoted") else ast.Value(self.literal())

    def condition(self) -> ast.Expression:
        if self.flat:
            return self.chain(("AND", "OR"), self.comparison)
        return self.chain(("OR",), lambda: self.chain(("AND",), self.comparison))

    def holds_condition(self) -> bool:
        """Whether the parenthesis that opens here holds a comparison; else it is an operand's."""
        depth = 0
        for kind, value in self.tokens[self.at :]:
            if kind in ("sign", "keyword"):
                depth += (value == "(") - (value == ")")
                if value in COMPARISONS and depth:
                    return True
            if not depth:
                return False
        return False

    def comparison(self) -> ast.Expression:
        if self.peek("(") and self.holds_condition():
            self.need("(")
            out = self.condition()
            self.need(")")
            return out
        left = self.sum(self.operand)
        sign = self.need(*COMPARISONS)
        return ast.Binary(sign, left, self.sum(self.operand))


def parse(text: str, flat: bool = False) -> ast.Statement:
    try:
        return Parser(text, flat).statement()
    except RecursionError as e:
        raise ParseError("too many parentheses inside each other") from e
