"""python -m tidemark WAREHOUSE [-l FILE]... [-q STATEMENT]... [--serve PORT]: a console, or a server."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .errors import EngineError
from .formatting import box
from .session import Session


def say(session: Session, text: str) -> bool:
    try:
        names, rows = [], []
        df = session.execute(text)
        if df is not None:
            session.give(df, rows.append, lambda s: names.extend(s.names))
        print(box(names, rows) if df is not None else f"ok, {session.last.rows} rows")
        if session.last.note:
            print(session.last.note)
        if session.config["print_execution_statistics"]:
            print(f"{session.last.rows} rows, planned in {session.last.planning_ms:.1f} ms, executed in {session.last.execution_ms:.1f} ms")
        return True
    except (EngineError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return False


def main() -> int:
    options = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    options.add_argument("warehouse")
    options.add_argument("-l", "--load", action="append", default=[])
    options.add_argument("-q", "--query", action="append", default=[])
    options.add_argument("--serve", type=int)
    given = options.parse_args()
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    with Session(spark, given.warehouse) as session:
        for path in given.load:
            session.load(path)
        if given.serve is not None:
            from .server import Server

            Server(spark, given.warehouse, given.serve).serve_forever()
            return 0
        ok = all([say(session, q) for q in given.query])
        if not given.query:
            for line in sys.stdin:
                if line.strip():
                    say(session, line)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
