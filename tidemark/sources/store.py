"""Versioned tables: immutable Parquet files and one log that says which files a version holds.

Entry N of the log is created exclusively, so of several writers exactly one makes version N; an entry may change several tables
at once. A snapshot is a version number. Reading a version replays the log from the last state file, one of which is written
every `KEEP` entries. Log and data go through Hadoop's file systems; exclusive creation needs a file system whose rename
does not overwrite (HDFS does not; local folders use links).
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableNotFound
from ..plans.ranges import kept

KEEP = 32


@dataclass
class TableState:
    id: int
    schema: T.StructType
    column_ids: dict[str, int]
    files: dict[str, int] = field(default_factory=dict)  # path below the table's folder: rows
    indices: list[dict] = field(default_factory=list)  # id, name, column, unique
    ranges: dict[str, dict[str, list]] = field(default_factory=dict)  # path: indexed column: least and greatest value

    @property
    def rows(self) -> int:
        return sum(self.files.values())


@dataclass
class State:
    version: int = 0
    tables: dict[str, TableState] = field(default_factory=dict)
    next_id: int = 5  # 1 to 4 are the system tables'
    next_column: int = 1
    next_index: int = 1

    def apply(self, entry: dict) -> State:
        """The state after a log entry; what it does not touch is shared."""
        tables, now = dict(self.tables), State(self.version + 1, {}, self.next_id, self.next_column, self.next_index)
        for name, schema in entry.get("create", {}).items():
            fields = T.StructType.fromJson(schema)
            tables[name] = TableState(now.next_id, fields, {f.name: now.next_column + i for i, f in enumerate(fields)})
            now.next_id += 1
            now.next_column += len(fields)
        for index in entry.get("index", []):
            t = tables[index["table"]]
            tables[index["table"]] = TableState(t.id, t.schema, t.column_ids, t.files, [*t.indices, {"id": now.next_index} | {k: index[k] for k in ("name", "column", "unique")}], t.ranges)
            now.next_index += 1
        for name, change in entry.get("files", {}).items():
            t, gone = tables[name], set(change["remove"])
            files = {f: n for f, n in t.files.items() if f not in gone} | change["add"]
            ranges = {f: r for f, r in t.ranges.items() if f not in gone} | change.get("ranges", {})
            tables[name] = TableState(t.id, t.schema, t.column_ids, files, t.indices, ranges)
        now.tables = tables
        return now

    def table(self, name: str) -> TableState:
        if name not in self.tables:
            raise TableNotFound(f"no table {name}")
        return self.tables[name]

    def to_json(self) -> dict:
        tables = {n: {"id": t.id, "schema": t.schema.jsonValue(), "column_ids": t.column_ids, "files": t.files, "indices": t.indices, "ranges": t.ranges} for n, t in self.tables.items()}
        return {"version": self.version, "next": [self.next_id, self.next_column, self.next_index], "tables": tables}

    @staticmethod
    def from_json(x: dict) -> State:
        tables = {n: TableState(t["id"], T.StructType.fromJson(t["schema"]), t["column_ids"], t["files"], t["indices"], t.get("ranges", {})) for n, t in x["tables"].items()}
        return State(x["version"], tables, *x["next"])


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(self._path(path)).toString().rstrip("/")
        self._fs.mkdirs(self._path(f"{self.root}/_log"))
        self._fs.mkdirs(self._path(f"{self.root}/data"))
        self._last = State()

    # ---- files

    def _read(self, path: str) -> dict | None:
        if not self._fs.exists(self._path(path)):
            return None
        with_in = self._fs.open(self._path(path))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_in, "UTF-8"))
        finally:
            with_in.close()

    def _create(self, path: str, content: dict) -> bool:
        """Writes a file that must not be there yet; False if it is."""
        passing = f"{self.root}/_log/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(passing), False)
        out.write(json.dumps(content).encode())
        out.close()
        if self._fs.getScheme() == "file":
            plain = lambda p: self._path(p).toUri().getPath()
            try:
                os.link(plain(passing), plain(path))
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(self._path(passing), False)
        done = not self._fs.exists(self._path(path)) and self._fs.rename(self._path(passing), self._path(path))
        if not done:
            self._fs.delete(self._path(passing), False)
        return done

    def _log(self, version: int, kind: str = "entry") -> str:
        return f"{self.root}/_log/{version:020d}.{kind}.json"

    # ---- versions

    def entry(self, version: int) -> dict | None:
        return self._read(self._log(version))

    def latest(self) -> State:
        state = self._last
        if state.version == 0:
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_log"))]
            saved = max((n for n in names if n.endswith(".state.json")), default=None)
            if saved:
                state = State.from_json(self._read(f"{self.root}/_log/{saved}"))
        while (entry := self.entry(state.version + 1)) is not None:
            state = state.apply(entry)
        self._last = state
        return state

    def commit(self, entry: dict, version: int) -> bool:
        """Makes `entry` version `version`; False if another writer has made that version."""
        if not self._create(self._log(version), entry):
            return False
        state = self.latest()
        if version % KEEP == 0 and state.version >= version:
            self._create(self._log(state.version, "state"), state.to_json())
        return True

    # ---- rows

    def folder(self, table: TableState) -> str:
        return f"{self.root}/data/{table.id}"

    def frame(self, table: TableState, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], table.schema)
        # files of a table all have its schema, so none is inferred; nullability is that of the table's declaration
        df = self.spark.read.schema(table.schema).parquet(*(f"{self.folder(table)}/{f}" for f in files))
        return df.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata or {}) for f in table.schema))

    def counted(self, table: TableState, files: list[str], where: Column | None = None) -> dict[str, int]:
        """Rows of each of `files`, or those for which `where` holds; files without any are left out. One number for each file reaches the driver."""
        if not files:
            return {}
        df = self.spark.read.schema(table.schema).parquet(*(f"{self.folder(table)}/{f}" for f in files))
        found = (df if where is None else df.filter(where)).groupBy("_metadata.file_path").count().collect()
        return {"/".join(r[0].split("/")[-2:]): r[1] for r in found}

    def write(self, table: TableState, df: DataFrame) -> dict[str, dict]:
        """Writes new files of a table, each sorted by its indexed columns: as `add` their names and rows, as `ranges` the least and greatest values of those columns.

        Empty files are left out. A row for each file reaches the driver.
        """
        name, columns = uuid.uuid4().hex, [i["column"] for i in table.indices]
        if columns:
            df = df.sortWithinPartitions(*(f"`{c}`" for c in columns))
        df.write.parquet(f"{self.folder(table)}/{name}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder(table)}/{name}")) if s.getPath().getName().startswith("part-")]
        if not found:
            return {"add": {}, "ranges": {}}
        ends = [f(f"`{c}`") for c in columns for f in (F.min, F.max)]
        written = self.spark.read.schema(table.schema).parquet(*(f"{self.folder(table)}/{name}/{f}" for f in found))
        out: dict[str, dict] = {"add": {}, "ranges": {}}
        for path, n, *values in written.groupBy("_metadata.file_path").agg(F.count(F.lit(1)), *ends).collect():
            file = "/".join(path.split("/")[-2:])
            pairs = {c: [kept(v) for v in values[2 * i : 2 * i + 2]] for i, c in enumerate(columns)}
            out["add"][file], out["ranges"][file] = n, {c: r for c, r in pairs.items() if r[1] == r[1]}  # not where NaN is the greatest
        out["ranges"] = {f: r for f, r in out["ranges"].items() if r}
        return out
