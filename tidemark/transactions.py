"""Optimistic serializable transactions over a store's versions.

A transaction reads the version at its begin plus its own changes, and stages new files. At commit every version made in between is
checked: it must not have replaced a file that this one replaces, nor changed rows that this one has read, which
are told by evaluating the conditions of its reads on the files that the other added or removed. Transactions that wrote nothing
read one version and always commit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import IndexExists, TableExists, TransactionAborted, UniqueViolation
from .plans import ast
from .plans.ranges import may_hold
from .sources.store import State, Store, TableState

ATTEMPTS = 50


class Transaction:
    def __init__(self, store: Store):
        self.store = store
        self.base: State = store.latest()
        self.state: State = self.base  # with what is staged
        self.entry: dict = {}
        self.reads: list[tuple[str, ast.Expression | None]] = []
        self.unique: set[tuple[str, str]] = set()  # tables and columns in which no value was there twice

    # ---- reading

    def table(self, name: str) -> TableState:
        return self.state.table(name)

    def frame(self, name: str, where: ast.Expression | None = None) -> DataFrame:
        """The table, or no less than its rows for which `where` holds: files that the log's ranges rule out are not given to the reader."""
        t = self.table(name)
        return self.store.frame(t, self._files(t, where))

    @staticmethod
    def _files(t: TableState, where: ast.Expression | None) -> list[str]:
        return [f for f in t.files if where is None or f not in t.ranges or may_hold(where, t.schema, t.ranges[f])]

    def read(self, name: str, where: ast.Expression | None) -> None:
        self.reads.append((name, where))

    # ---- staging

    def _stage(self, change: dict) -> None:
        self.state = self.state.apply(change)
        self.entry.setdefault("create", {}).update(change.get("create", {}))
        self.entry.setdefault("index", []).extend(change.get("index", []))
        for name, files in change.get("files", {}).items():
            mine = self.entry.setdefault("files", {}).setdefault(name, {"add": {}, "remove": [], "ranges": {}})
            for f in files["remove"]:  # a file of this transaction is simply taken back
                mine["ranges"].pop(f, None)
                if mine["add"].pop(f, None) is None:
                    mine["remove"].append(f)
            mine["add"].update(files["add"])
            mine["ranges"].update(files["ranges"])

    def create(self, name: str, schema: T.StructType) -> None:
        if name in self.state.tables:
            raise TableExists(f"table {name} is there already")
        self._stage({"create": {name: schema.jsonValue()}})

    def insert(self, name: str, rows: DataFrame) -> int:
        written = self.store.write(self.table(name), rows)
        self._stage({"files": {name: written | {"remove": []}}})
        return sum(written["add"].values())

    def rewrite(self, name: str, where: Column, change: Callable[[DataFrame], DataFrame], told: ast.Expression | None = None) -> int:
        """Replaces the files that hold rows for which `where` holds by `change` of all their rows; how many rows it held for. `told` is the condition as it was written."""
        t = self.table(name)
        hit = self.store.counted(t, self._files(t, told), where)
        if hit:
            self._stage({"files": {name: self.store.write(t, change(self.store.frame(t, list(hit)))) | {"remove": list(hit)}}})
        return sum(hit.values())

    def index(self, name: str, table: str, column: str, unique: bool) -> None:
        """Registers an index and lays the table out by ranges of its column, so that file and row-group statistics skip what a filter rules out."""
        t = self.table(table)
        if any(i["name"] == name for x in self.state.tables.values() for i in x.indices) or any(i["column"] == column for i in t.indices):
            raise IndexExists(f"index {name} or another one on {table}({column}) is there already")
        if unique:
            self.read(table, None)
        self._stage({"index": [{"name": name, "table": table, "column": column, "unique": unique}]})
        if t.files:
            self.replace(table, self.frame(table).repartitionByRange(F.col(f"`{column}`")))

    def replace(self, name: str, rows: DataFrame) -> None:
        t = self.table(name)
        self.read(name, None)
        self._stage({"files": {name: self.store.write(t, rows) | {"remove": list(t.files)}}})

    def check_unique(self, name: str, whole: bool = False) -> None:
        """That no value of a unique column is there twice, as far as this transaction's files go, or in the `whole` table.

        Files of others are read only where their ranges overlap those of new files. What others add meanwhile is compared at commit.
        """
        t = self.table(name)
        mine = [f for f in self.entry.get("files", {}).get(name, {}).get("add", {}) if f in t.files]
        for i in t.indices:
            if not i["unique"]:
                continue
            column = i["column"]
            looked = list(t.files) if whole else mine
            twice = bool(looked) and self.store.frame(t, looked).groupBy(f"`{column}`").count().filter("count > 1").limit(1).count() > 0
            if twice or not whole and self._shared(t, column, mine, [f for f in t.files if f not in set(mine)]):
                raise UniqueViolation(f"{name}({column}) holds a value twice")
            self.unique.add((name, column))

    def _shared(self, t: TableState, column: str, mine: list[str], others: list[str]) -> bool:
        """Whether a value of `column` is both in the files `mine` and in `others`."""
        own = [t.ranges.get(f, {}).get(column) for f in mine]
        if all(r and r[0] is not None for r in own) and own:
            least, greatest = min(r[0] for r in own), max(r[1] for r in own)
            apart = lambda r: r and r[0] is not None and (r[1] < least or r[0] > greatest)
            others = [f for f in others if not apart(t.ranges.get(f, {}).get(column))]
        if not mine or not others:
            return False
        here, there = (self.store.frame(t, files).select(F.col(f"`{column}`").alias(c)) for files, c in ((mine, "a"), (others, "b")))
        return there.join(here, F.col("a").eqNullSafe(F.col("b")), "left_semi").limit(1).count() > 0

    # ---- the end

    def commit(self, holds: Callable[[TableState, ast.Expression], Column]) -> int:
        """Publishes what is staged; `holds` binds a read's condition to a table's columns. The version that is now there."""
        if not any(self.entry.get(k) for k in ("create", "index", "files")):
            return self.base.version
        seen = self.base.version
        for _ in range(ATTEMPTS):
            now = self.store.latest()
            while seen < now.version:
                seen += 1
                self._check(self.store.entry(seen), now, holds)
            if self.store.commit(self.entry, now.version + 1):
                return now.version + 1
        raise TransactionAborted("Transaction aborted: too many concurrent commits")

    def _check(self, other: dict, now: State, holds: Callable[[TableState, ast.Expression], Column]) -> None:
        if set(other.get("create", {})) & set(self.entry.get("create", {})):
            raise TransactionAborted("Transaction aborted: another one has created the table")
        if {i["name"] for i in other.get("index", [])} & {i["name"] for i in self.entry.get("index", [])}:
            raise TransactionAborted("Transaction aborted: another one has created the index")
        for i in other.get("index", []):
            if i["unique"] and self.entry.get("files", {}).get(i["table"], {}).get("add"):
                raise TransactionAborted("Transaction aborted: another one has made a column unique that it has written")
        for name, change in other.get("files", {}).items():
            mine = self.entry.get("files", {}).get(name, {"remove": []})
            if set(mine["remove"]) & set(change["remove"]):
                raise TransactionAborted("Transaction aborted: another one has changed the same rows")
            files = [*change["add"], *change["remove"]]
            for _, column in [u for u in self.unique if u[0] == name]:
                if self._shared(now.table(name), column, list(mine.get("add", {})), list(change["add"])):
                    raise TransactionAborted("Transaction aborted: another one has added a value of a unique column")
            for where in [w for n, w in self.reads if n == name]:
                table = now.table(name)
                if files and (where is None or self.store.frame(table, files).filter(holds(table, where)).limit(1).count()):
                    raise TransactionAborted("Transaction aborted: another one has changed rows that it has read")
