"""Inspection commands: a colon, a word, parameters."""

from __future__ import annotations

import json
import re
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from .config import IDLE
from .errors import CommandError

if TYPE_CHECKING:
    from .session import Session

#: The statements behind `:show`.
SHOW = {
    "tables": "SELECT name AS table_name FROM system_tables ORDER BY id ASC",
    "columns": "SELECT t.name AS table_name, c.name AS column_name FROM system_columns c JOIN system_tables t ON c.table_id = t.id ORDER BY t.id ASC, c.id ASC",
    "indices": "SELECT t.name AS table_name, c.name AS column_name, i.name AS index_name, i.is_unique AS is_unique, i.type_id AS type FROM system_indices i "
    "JOIN system_columns c ON i.column_id = c.id JOIN system_tables t ON c.table_id = t.id ORDER BY t.id ASC, c.id ASC, i.id ASC",
}


def show(session: Session, what: str) -> DataFrame:
    if what.lower() not in SHOW:
        raise CommandError(f":show knows {', '.join(SHOW)}, but not {what or 'nothing'}")
    return session.execute(SHOW[what.lower()])


def explain(session: Session, text: str) -> DataFrame:
    """One row: the logical plan as JSON, and Spark's physical plan."""
    if not text:
        raise CommandError(":explain needs a SELECT to explain")
    plan = session.plan(re.sub(r"(?i)^plan\s+", "", text))
    physical = plan.df._jdf.queryExecution().executedPlan().toString()
    return session.spark.createDataFrame([(json.dumps(plan.logical), physical)], "plan string, physical string")


def set_option(session: Session, text: str) -> DataFrame:
    m = re.fullmatch(r"(\w+)\s+(.+)", text)
    if not m:
        raise CommandError(":set needs the name of an option and a whole number")
    if not re.fullmatch("[0-9]+", m[2]):
        raise CommandError(f"{m[2]} is no whole number")
    old = session.config.set(m[1], int(m[2]))
    session.last.note = f"{m[1]} changes nothing here, as Spark plans that itself" if m[1] in IDLE else ""
    return session.spark.createDataFrame([(m[1], int(m[2]), old)], "option string, value int, was int")


def get_option(session: Session, text: str) -> DataFrame:
    if text and not re.fullmatch(r"\w+", text):
        raise CommandError(f"{text} cannot be the name of an option")
    found = {text: session.config[text]} if text else session.config.values
    return session.spark.createDataFrame(sorted(found.items()), "option string, value int")


def stats(session: Session, table: str) -> DataFrame:
    """Counts a table's rows anew and shows the count next to the one that the catalog keeps."""
    if not re.fullmatch(r"\w+", table):
        raise CommandError(f"{table} cannot be the name of a table" if table else ":stats needs the name of a table")
    state = (session.open.state if session.open else session.store.latest()).tables
    if table not in state:
        raise CommandError(f"there is no table {table}")
    counted = session.execute(f"SELECT COUNT(*) AS cardinality FROM `{table}`").first()[0]
    return session.spark.createDataFrame([(table, counted, state[table].rows, len(state[table].files))], "table_name string, cardinality long, catalog long, files int")


def stop(session: Session, _: str) -> None:
    session.open = None
    session.spark.stop()


COMMANDS = {"show": show, "explain": explain, "set": set_option, "get": get_option, "stats": stats, "stop": stop}


def register(name: str, command) -> None:
    """Adds a command: a function of the session and the text behind the name."""
    COMMANDS[name] = command


def run_command(session: Session, text: str) -> DataFrame | None:
    m = re.fullmatch(r":([\w\-]+)\s*(.*?)\s*;?", text, re.DOTALL)
    if not m or m[1].lower() not in COMMANDS:
        raise CommandError(f"unknown command {text.split()[0]}; there are {', '.join(':' + c for c in COMMANDS)}")
    return COMMANDS[m[1].lower()](session, m[2])
