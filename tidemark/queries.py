"""Registered relational queries, one or more for each operator, and the SQL that gives the same rows.

Queries that change tables run a session over a warehouse of their own in the folder that the cluster shares.
"""

from __future__ import annotations

import contextlib
import io
import json
import threading
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import TransactionAborted
from .formatting import arrow_bytes, boxed, json_lines
from .functions.scalar import divide_whole
from .operators import relational as op
from .server import Client, Server
from .session import Session
from .shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return keep


def _dialect(name: str, text: str, sql: str | None = None, *tables: str) -> None:
    """A query given in the dialect, over views of the Parquet tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _session(spark, sf_dir, *tables).execute(text)

    _QUERIES[name], _SQL[name] = run, sql or text


def _session(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    session = Session(spark, f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}")
    for t in tables:
        session.view(t, op.scan(spark, sf_dir, t))
    return session


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- scans, projection, arithmetic


@_query("SELECT * FROM nation")
def scan_star(spark, d):
    return op.scan(spark, d, "nation")


@_query("SELECT o_orderkey AS k, o_totalprice AS p FROM orders")
def project_alias(spark, d):
    return op.project(op.scan(spark, d, "orders"), k=F.col("o_orderkey"), p=F.col("o_totalprice"))


@_query("SELECT l_orderkey, l_linenumber, (l_quantity * l_extendedprice) AS m, (l_extendedprice - l_discount) AS d, (l_quantity + l_tax) AS s FROM lineitem")
def arith_add_mul(spark, d):
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    return op.project(op.scan(spark, d, "lineitem"), l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), m=q * e, d=e - F.col("l_discount"), s=q + F.col("l_tax"))


@_query("SELECT o_orderkey, (o_custkey * o_totalprice) AS v FROM orders")
def int_times_double(spark, d):
    return op.project(op.scan(spark, d, "orders"), o_orderkey=F.col("o_orderkey"), v=F.col("o_custkey") * F.col("o_totalprice"))


@_query("SELECT o_orderkey, (o_orderkey // o_custkey) AS v FROM orders WHERE o_custkey <> 0")
def arith_int_div(spark, d):
    df = op.select(op.scan(spark, d, "orders"), F.col("o_custkey") != 0)
    return op.project(df, o_orderkey=F.col("o_orderkey"), v=divide_whole(F.col("o_orderkey"), F.col("o_custkey")))


@_query("SELECT l_orderkey, l_linenumber, (l_extendedprice / l_quantity) AS r FROM lineitem WHERE l_quantity > 0")
def arith_real_div(spark, d):
    df = op.select(op.scan(spark, d, "lineitem"), F.col("l_quantity") > 0)
    return op.project(df, l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), r=F.col("l_extendedprice") / F.col("l_quantity"))


@_query("SELECT n_nationkey + 100 AS a, 100 - n_nationkey AS b, 2 * 3 AS c FROM nation")
def arith_literals(spark, d):
    return op.project(op.scan(spark, d, "nation"), a=F.col("n_nationkey") + 100, b=100 - F.col("n_nationkey"), c=F.lit(2) * F.lit(3))


# ---- filters


@_query("SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def filter_ne(spark, d):
    return op.select(op.scan(spark, d, "orders"), F.col("o_orderstatus") != "F")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE 50000 < o_totalprice")
def filter_swap(spark, d):
    return op.select(op.scan(spark, d, "orders", "o_orderkey", "o_totalprice"), F.lit(50000) < F.col("o_totalprice"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey <= l_suppkey")
def filter_attr_attr(spark, d):
    return op.select(op.scan(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.col("l_partkey") <= F.col("l_suppkey"))


@_query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice >= 1000 AND o_totalprice < 90000")
def filter_and_or(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return op.select(op.scan(spark, d, "orders"), (s == "F") | (s == "O"), p >= 1000, p < 90000).select("o_orderkey")


@_query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01'")
def filter_date(spark, d):
    day = F.col("o_orderdate").cast("date")
    return op.project(op.select(op.scan(spark, d, "orders"), day >= F.lit("1997-01-01").cast("date")), o_orderkey=F.col("o_orderkey"), d=day)


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_extendedprice * l_discount) > 5000")
def filter_arith(spark, d):
    return op.select(op.scan(spark, d, "lineitem"), F.col("l_extendedprice") * F.col("l_discount") > 5000).select("l_orderkey", "l_linenumber")


@_query("SELECT p_partkey FROM part WHERE p_size = 15 OR p_size > 45")
def index_range(spark, d):
    return op.select(op.scan(spark, d, "part", "p_partkey", "p_size"), (F.col("p_size") == 15) | (F.col("p_size") > 45)).select("p_partkey")


# ---- joins


@_query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_equi(spark, d):
    o, c = op.scan(spark, d, "orders", "o_orderkey", "o_custkey"), op.scan(spark, d, "customer", "c_custkey", "c_name")
    return op.join(o, c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@_query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_hash(spark, d):
    o, c = op.scan(spark, d, "orders", "o_orderkey", "o_custkey"), op.scan(spark, d, "customer", "c_custkey", "c_name")
    return op.join(o, c, o.o_custkey == c.c_custkey, "shuffle_hash").select("o_orderkey", "c_name")


@_query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_chain(spark, d):
    s, n, r = op.scan(spark, d, "supplier"), op.scan(spark, d, "nation"), op.scan(spark, d, "region")
    return op.join(op.join(s, n, s.s_nationkey == n.n_nationkey), r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@_query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def self_join(spark, d):
    a, b = op.scan(spark, d, "nation").alias("a"), op.scan(spark, d, "nation").alias("b")
    return op.join(a, b, F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


def _theta(spark, d, on):
    s, n = op.scan(spark, d, "supplier"), op.scan(spark, d, "nation")
    return op.join(s, n, on(F.col("s_nationkey"), F.col("n_nationkey"))).select("s_suppkey", "n_nationkey")


@_query("SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey < n_nationkey")
def theta_join(spark, d):
    return _theta(spark, d, lambda a, b: a < b)


@_query("SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey >= n_nationkey")
def theta_ge(spark, d):
    return _theta(spark, d, lambda a, b: a >= b)


@_query("SELECT r_name, n_name FROM region, nation")
def cross(spark, d):
    return op.cross(op.scan(spark, d, "region", "r_name"), op.scan(spark, d, "nation", "n_name"))


# ---- aggregation


@_query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def agg_global(spark, d):
    q = F.col("l_quantity")
    df = op.group(op.scan(spark, d, "lineitem", "l_quantity", "l_shipdate"), (), n=("COUNT", None), s=("SUM", q), a=("AVG", q), lo=("MIN", F.col("l_shipdate")), hi=("MAX", F.col("l_shipdate")))
    return df.withColumn("s", F.round("s", 2)).withColumn("a", F.round("a", 6))


@_query("SELECT count(*) AS n, CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS s, coalesce(avg(o_custkey), 'NaN'::DOUBLE) AS a, min(o_custkey) AS lo FROM orders WHERE o_orderkey < 0")
def agg_empty(spark, d):
    k = F.col("o_custkey")
    return op.group(op.select(op.scan(spark, d, "orders"), F.col("o_orderkey") < 0), (), n=("COUNT", None), s=("SUM", k), a=("AVG", k), lo=("MIN", k))


@_query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS s, max(o_totalprice) AS m FROM orders GROUP BY o_orderstatus")
def agg_group(spark, d):
    p = F.col("o_totalprice")
    return op.group(op.scan(spark, d, "orders"), ["o_orderstatus"], s=("SUM", p), m=("MAX", p)).withColumn("s", F.round("s", 2))


@_query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def count_star_group(spark, d):
    return op.group(op.scan(spark, d, "nation"), ["n_regionkey"], n=("COUNT", None))


@_query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS a, count(l_tax) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def avg_group(spark, d):
    df = op.group(op.scan(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], a=("AVG", F.col("l_quantity")), n=("COUNT", F.col("l_tax")))
    return df.withColumn("a", F.round("a", 6))


@_query("SELECT l_returnflag, round(sum(l_extendedprice * l_discount), 2) AS s FROM lineitem GROUP BY l_returnflag")
def agg_expr(spark, d):
    return op.group(op.scan(spark, d, "lineitem"), ["l_returnflag"], s=("SUM", F.col("l_extendedprice") * F.col("l_discount"))).withColumn("s", F.round("s", 2))


@_query("SELECT l_linestatus, round(sum(l_extendedprice) / count(l_quantity), 4) AS r FROM lineitem GROUP BY l_linestatus")
def agg_over_agg_arith(spark, d):
    out = _session(spark, d, "lineitem").execute("SELECT l_linestatus, SUM(l_extendedprice) / COUNT(l_quantity) AS r FROM lineitem GROUP BY l_linestatus")
    return out.withColumn("r", F.round("r", 4))


@_query("SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_noagg(spark, d):
    return op.group(op.scan(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@_query("SELECT event_type, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events WHERE value > 10 GROUP BY event_type")
def events_filter(spark, d):
    df = op.select(op.scan(spark, d, "events"), F.col("value") > 10)
    return op.group(df, ["event_type"], n=("COUNT", None), lo=("MIN", F.col("ts")), hi=("MAX", F.col("ts")))


# ---- order and limit


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def order_limit(spark, d):
    return op.limit(op.order(op.scan(spark, d, "orders", "o_orderkey", "o_totalprice"), ("o_totalprice", False), ("o_orderkey", True)), 25, 5)


@_query("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def order_nonselected(spark, d):
    return op.limit(op.order(op.scan(spark, d, "customer"), ("c_acctbal", False), ("c_custkey", True)), 20).select("c_name")


@_query(
    """SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-01' AND l_returnflag <> 'A' GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10"""
)
def flagship(spark, d):
    c = op.scan(spark, d, "customer", "c_custkey", "c_nationkey")
    o = op.select(op.scan(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate"), F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).drop("o_orderdate")
    li = op.select(op.scan(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount", "l_returnflag"), F.col("l_returnflag") != "A")
    n = op.scan(spark, d, "nation", "n_nationkey", "n_name")
    co = op.join(o, c, o.o_custkey == c.c_custkey)
    df = op.join(op.join(li, co, li.l_orderkey == o.o_orderkey), n, c.c_nationkey == n.n_nationkey)
    told = op.group(df, ["n_name"], n=("COUNT", None), revenue=("SUM", F.col("l_extendedprice") * (1 - F.col("l_discount"))))
    return op.limit(op.order(told.withColumn("revenue", F.round("revenue", 2)), ("revenue", False), ("n_name", True)), 10)


# ---- the dialect

_dialect("sql_where", "SELECT o_orderkey, o_totalprice AS p FROM orders WHERE o_orderstatus <> 'F' AND (o_totalprice > 1000.5 OR o_custkey = 7)", None, "orders")
_dialect("sql_join", "SELECT c.c_name AS name, o.o_orderkey AS k FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0", None, "orders", "customer")
_dialect("sql_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", None, "nation")
_dialect(
    "sql_group",
    "SELECT l_returnflag, COUNT(*) AS n, MAX(l_quantity) AS m, SUM(l_linenumber) AS s FROM lineitem WHERE l_quantity <= 25 GROUP BY l_returnflag ORDER BY l_returnflag",
    "SELECT l_returnflag, COUNT(*) AS n, MAX(l_quantity) AS m, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_quantity <= 25 GROUP BY l_returnflag ORDER BY l_returnflag",
    "lineitem",
)
_dialect("sql_order_limit", "SELECT p_partkey AS k, p_retailprice * 2 AS p FROM part WHERE p_size >= 10 ORDER BY p_retailprice DESC, p_partkey ASC LIMIT 15 OFFSET 3", None, "part")
_dialect("sql_int_div", "SELECT s_suppkey, (s_suppkey / 7) AS v, (s_acctbal / 2) AS h FROM supplier", "SELECT s_suppkey, (s_suppkey // 7) AS v, (s_acctbal / 2) AS h FROM supplier", "supplier")
_dialect("sql_star_order", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey", None, "nation", "region")


_dialect("sql_qualified_star", "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", 'SELECT n_nationkey AS "n.n_nationkey", n_name AS "n.n_name", n_regionkey AS "n.n_regionkey" FROM nation', "nation", "region")
_dialect("sql_literals_alone", "SELECT r_regionkey, r_name FROM region WHERE 1 < 2 AND 3 = 3", None, "region")
_dialect("sql_count_star_of", "SELECT COUNT(n.*) AS c FROM nation n, region r", "SELECT count(*) AS c FROM nation, region", "nation", "region")


@_query("SELECT s_suppkey, (2 + s_suppkey) * 3 AS v FROM supplier")
def sql_flat_precedence(spark, d):
    s = _session(spark, d, "supplier")
    s.execute(":set flat_precedence 1")
    return s.execute("SELECT s_suppkey, 2 + s_suppkey * 3 AS v FROM supplier")


# ---- tables that change


@_query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_as_query(spark, d):
    s = _session(spark, d)
    s.create_from("orders", op.scan(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice"))
    s.execute("UPDATE orders SET o_totalprice = 0 WHERE o_orderstatus = 'P'")
    return s.execute("SELECT o_orderkey, o_totalprice FROM orders")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT coalesce(o_totalprice < 50000, false)")
def delete_as_query(spark, d):
    s = _session(spark, d)
    s.create_from("orders", op.scan(spark, d, "orders", "o_orderkey", "o_totalprice"))
    s.execute("DELETE FROM orders WHERE o_totalprice < 50000")
    return s.execute("SELECT o_orderkey, o_totalprice FROM orders")


@_query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'Atla' UNION ALL SELECT 101, '42'")
def insert_as_query(spark, d):
    s = _session(spark, d)
    s.execute("CREATE TABLE n (n_nationkey INT, n_name CHAR(4))")
    s.execute("INSERT INTO n (n_name, n_nationkey) VALUES ('Atlantis', 100), ('42', 101)")
    s.view("nation", op.scan(spark, d, "nation", "n_nationkey", "n_name"))
    return s.execute("SELECT n_nationkey, n_name FROM nation").union(s.execute("SELECT n_nationkey, n_name FROM n"))


@_query("SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_nationkey <> 3")
def txn_commit(spark, d):
    s = _session(spark, d)
    s.create_from("customer", op.scan(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal"))
    for text in ("BEGIN", "UPDATE customer SET c_acctbal = c_acctbal + 1", "DELETE FROM customer WHERE c_nationkey = 3", "COMMIT"):
        s.execute(text)
    return s.execute("SELECT c_custkey, c_acctbal FROM customer")


@_query("SELECT c_custkey, c_acctbal FROM customer")
def txn_abort(spark, d):
    s = _session(spark, d)
    s.create_from("customer", op.scan(spark, d, "customer", "c_custkey", "c_acctbal"))
    for text in ("BEGIN", "DELETE FROM customer WHERE c_custkey > 5", "ABORT"):
        s.execute(text)
    return s.execute("SELECT c_custkey, c_acctbal FROM customer")


@_query("SELECT p_partkey, p_size FROM part WHERE p_size > 40 AND p_size <= 45")
def index_scan(spark, d):
    s = _session(spark, d)
    s.create_from("part", op.scan(spark, d, "part", "p_partkey", "p_size"))
    s.execute("CREATE INDEX part_size ON part(p_size)")
    return s.execute("SELECT p_partkey, p_size FROM part WHERE p_size > 40 AND p_size <= 45")


@_query("SELECT 'nation' AS table_name, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name")
def show_columns(spark, d):
    s = _session(spark, d)
    s.create_from("nation", op.scan(spark, d, "nation"))
    return s.execute(":show columns")


@_query("SELECT 'supplier' AS table_name, count(*) AS cardinality, count(*) AS catalog FROM supplier")
def stats_command(spark, d):
    s = _session(spark, d)
    s.create_from("supplier", op.scan(spark, d, "supplier"))
    return s.execute(":stats supplier").drop("files")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 120 UNION ALL SELECT 110, 7.5")
def index_of_later_rows(spark, d):
    """Rows that are inserted after the index was made are found by it, in files that the log's ranges do not rule out."""
    s = _session(spark, d)
    s.create_from("orders", op.scan(spark, d, "orders", "o_orderkey", "o_totalprice"))
    s.execute("CREATE INDEX by_key ON orders(o_orderkey)")
    s.execute("INSERT INTO orders (o_orderkey, o_totalprice) VALUES (110, 7.5), (1000000000, 1)")
    return s.execute("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 120")


@_query("SELECT 1 AS id, 'kept' AS note UNION ALL SELECT 2, 'new'")
def create_if_not_exists(spark, d):
    s = _session(spark, d)
    for text in ("CREATE TABLE t (id INT, note CHAR(8))", "INSERT INTO t (id, note) VALUES (1, 'kept')", "CREATE TABLE IF NOT EXISTS t (other INT)", "INSERT INTO t (id, note) VALUES (2, 'new')"):
        s.execute(text)
    return s.execute("SELECT id, note FROM t")


# ---- transactions of two sessions


def _two(spark, d) -> tuple[Session, Session]:
    """Sessions over one store with a table of accounts."""
    a = _session(spark, d)
    a.execute("CREATE TABLE t (id INT, bal INT)")
    a.execute("INSERT INTO t (id, bal) VALUES (1, 10), (2, 20)")
    return a, Session(spark, a.store.root)


def _ended(s: Session) -> str:
    try:
        s.execute("COMMIT")
        return "committed"
    except TransactionAborted:
        return "aborted"


def _both(a: Session, b: Session, of_a: list[str], of_b: list[str]) -> DataFrame:
    """The statements of both in transactions that overlap; a commits first. The table afterwards, each row with how the two ended."""
    for s, texts in ((a, of_a), (b, of_b)):
        s.execute("BEGIN")
        for text in texts:
            if (df := s.execute(text)) is not None:
                df.collect()
    ends = _ended(a), _ended(b)
    return a.execute("SELECT id, bal FROM t").select("id", "bal", F.lit(ends[0]).alias("a"), F.lit(ends[1]).alias("b"))


@_query("SELECT 1 AS id, 11 AS bal, 'committed' AS a, 'aborted' AS b UNION ALL SELECT 2, 20, 'committed', 'aborted'")
def conflict_write_write(spark, d):
    return _both(*_two(spark, d), ["UPDATE t SET bal = bal + 1 WHERE id = 1"], ["UPDATE t SET bal = bal + 5 WHERE id = 1"])


@_query("SELECT unnest([1, 2, 3]) AS id, unnest([10, 20, -15]) AS bal, 'committed' AS a, 'aborted' AS b")
def conflict_read_set(spark, d):
    """Each has read what the other changes."""
    read = "SELECT SUM(bal) AS s FROM t"
    return _both(*_two(spark, d), [read, "INSERT INTO t (id, bal) VALUES (3, -15)"], [read, "INSERT INTO t (id, bal) VALUES (4, -15)"])


@_query("SELECT unnest([1, 2, 3]) AS id, unnest([10, 20, 500]) AS bal, 'committed' AS a, 'aborted' AS b")
def conflict_phantom(spark, d):
    """b has found no row where a adds one."""
    return _both(*_two(spark, d), ["INSERT INTO t (id, bal) VALUES (3, 500)"], ["SELECT COUNT(*) AS n FROM t WHERE bal > 100", "INSERT INTO t (id, bal) VALUES (4, 1)"])


@_query("SELECT unnest([1, 2, 3, 4]) AS id, unnest([10, 20, 50, 1]) AS bal, 'committed' AS a, 'committed' AS b")
def no_conflict_through_join(spark, d):
    """a adds a row outside of what b has read of the table in a join."""
    a, b = _two(spark, d)
    a.execute("CREATE TABLE u (id INT)")
    a.execute("INSERT INTO u (id) VALUES (1)")
    return _both(a, b, ["INSERT INTO t (id, bal) VALUES (3, 50)"], ["SELECT t.id FROM t JOIN u ON t.id = u.id WHERE t.bal > 100", "INSERT INTO t (id, bal) VALUES (4, 1)"])


@_query("SELECT unnest([1, 2, 99]) AS id, unnest([10, 20, 1]) AS bal, 'committed' AS a, 'aborted' AS b")
def conflict_unique(spark, d):
    a, b = _two(spark, d)
    a.execute("CREATE UNIQUE INDEX by_id ON t(id)")
    for s in (a, b):
        s.execute(":set enforce_unique 1")
    return _both(a, b, ["INSERT INTO t (id, bal) VALUES (99, 1)"], ["INSERT INTO t (id, bal) VALUES (99, 2)"])


@_query("SELECT 'snapshot' AS seen, sum(x) AS s FROM (VALUES (10), (20)) v(x) UNION ALL SELECT 'own', 35 UNION ALL SELECT 'after', 130")
def snapshot_reads(spark, d):
    """A transaction sees the version of its begin and its own changes; when it is given up, what others have committed."""
    a, b = _two(spark, d)
    told = []
    look = lambda name: told.append((name, a.execute("SELECT SUM(bal) AS s FROM t").first()[0]))
    a.execute("BEGIN")
    b.execute("UPDATE t SET bal = bal + 100 WHERE id = 1")
    look("snapshot")
    a.execute("INSERT INTO t (id, bal) VALUES (3, 5)")
    look("own")
    a.execute("ABORT")
    look("after")
    return spark.createDataFrame(told, "seen string, s long")


@_query("SELECT unnest([1, 2]) AS id, unnest([10, 20]) AS bal")
def abort_at_disconnect(spark, d):
    a, b = _two(spark, d)
    with b:
        b.execute("BEGIN")
        b.execute("DELETE FROM t")
    return a.execute("SELECT id, bal FROM t")


# ---- loaders, results, commands, console, server


def _file(spark, s: Session, name: str, lines: DataFrame) -> str:
    """A text file or folder of this name in the session's own folder."""
    path = f"{s.store.root}/files/{name}"
    lines.write.text(path)
    return path


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tbl_file(spark, d):
    s = _session(spark, d)
    s.execute("CREATE TABLE nation (n_nationkey INT, n_name CHAR(25), n_regionkey INT)")
    s.load(_file(spark, s, "nation.tbl", op.scan(spark, d, "nation").select(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey", F.lit("")))))
    return s.execute("SELECT n_nationkey, n_name, n_regionkey FROM nation")


@_query("SELECT 1 AS id, 'Alien' AS name UNION ALL SELECT 2, 'Brazil'")
def sql_file(spark, d):
    s = _session(spark, d)
    script = "CREATE TABLE movie (id INT,\nname CHAR(8));\n-- a remark\n/*\nINSERT INTO movie (id, name) VALUES (9, 'no');\n*/\nINSERT INTO movie (id, name)\nVALUES (1, 'Alien'), (2, 'Brazil');\n"
    s.load(_file(spark, s, "movie.sql", spark.createDataFrame([(script,)], "value string").coalesce(1)))
    return s.execute("SELECT id, name FROM movie")


@_query("SELECT n_nationkey, n_name, n FROM nation, (SELECT count(*) AS n FROM nation)")
def rows_one_by_one(spark, d):
    """Rows given to a callback, and their number."""
    s, rows, names = _session(spark, d, "nation"), [], []
    n = s.each("SELECT n_nationkey, n_name FROM nation", rows.append, lambda schema: names.extend(schema.names))
    return spark.createDataFrame([(*r, s.last.rows) for r in rows if n == s.last.rows], f"{names[0]} int, {names[1]} string, n long")


@_query("SELECT '│ ' || rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || ' │ ' || rpad(r_name, CAST((SELECT greatest(6, max(length(r_name))) FROM region) AS INTEGER), ' ') || ' │' AS line FROM region")
def boxed_rows(spark, d):
    lines = boxed(_session(spark, d, "region").execute("SELECT r_regionkey, r_name FROM region")).split("\n")
    return spark.createDataFrame([(x,) for x in lines[3:-1]], "line string")


@_query("SELECT r_regionkey, r_name, 'json' AS kind FROM region UNION ALL SELECT r_regionkey, r_name, 'arrow' FROM region")
def serialized_rows(spark, d):
    """Rows written as JSON lines and as Arrow bytes, and read again."""
    df = _session(spark, d, "region").execute("SELECT r_regionkey, r_name FROM region")
    there = [(*json.loads(x).values(), "json") for x in json_lines(df)]
    there += [(*r.values(), "arrow") for r in pa.ipc.open_stream(arrow_bytes(df)).read_all().to_pylist()]
    return spark.createDataFrame(there, "r_regionkey int, r_name string, kind string")


@_query("SELECT unnest(['t', 'u']) AS table_name")
def show_tables(spark, d):
    s = _session(spark, d)
    for t in "tu":
        s.execute(f"CREATE TABLE {t} (id INT)")
    return s.execute(":show tables")


@_query("SELECT 't' AS table_name, unnest(['id', 'bal']) AS column_name, unnest(['one', 'two']) AS index_name, unnest([1, 0]) AS is_unique, 1 AS type")
def show_indices(spark, d):
    s, _ = _two(spark, d)
    s.execute("CREATE UNIQUE INDEX one ON t(id)")
    s.execute("CREATE INDEX two ON t(bal)")
    return s.execute(":show indices")


@_query("SELECT unnest(['Projection', 'Limit', 'Order By', 'Aggregation', 'Selection', 'TableScan']) AS node, unnest([0, 1, 2, 3, 4, 5]) AS depth")
def explain_command(spark, d):
    """The logical plan's nodes from the top."""
    s, out = _session(spark, d, "nation"), []
    plan = json.loads(s.execute(":explain SELECT n_regionkey, COUNT(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey ORDER BY n_regionkey LIMIT 3").first()["plan"])
    while plan:
        out.append((plan["name"], len(out)))
        plan = next(iter(plan["childs"]), None)
    return spark.createDataFrame(out, "node string, depth int")


@_query("SELECT 'set' AS command, 'enable_hash_join' AS option, 1 AS value, 0 AS was UNION ALL SELECT 'get', 'enable_hash_join', 1, NULL")
def set_and_get(spark, d):
    s = _session(spark, d)
    was = s.execute(":set enable_hash_join 1").select(F.lit("set").alias("command"), "*")
    return was.unionByName(s.execute(":get enable_hash_join").select(F.lit("get").alias("command"), "*"), allowMissingColumns=True)


@_query("SELECT '│ ' || CAST(count(*) AS VARCHAR) || ' │' AS line FROM nation")
def console(spark, d):
    """What the console prints for a statement."""
    from .__main__ import say

    s, out = _session(spark, d, "nation"), io.StringIO()
    with contextlib.redirect_stdout(out):
        say(s, "SELECT COUNT(*) AS n FROM nation")
    return spark.createDataFrame([(out.getvalue().split("\n")[3],)], "line string")


@_query("SELECT 'rows' AS kind, 5 AS x UNION ALL SELECT 'after', 1")
def line_server(spark, d):
    """Replies of the server to two clients; what the first left open is given up."""
    server = Server(spark, f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    one = Client(port=server.server_address[1])
    for text in ("CREATE TABLE t (id INT)", "INSERT INTO t (id) VALUES (5)"):
        one.send(text)
    found = [("rows", one.send("SELECT id AS x FROM t")["rows"][0][0])]
    one.send("BEGIN")
    one.send("DELETE FROM t")
    one.close()
    two = Client(port=server.server_address[1])
    found.append(("after", two.send("SELECT COUNT(*) AS n FROM t")["rows"][0][0]))
    two.send(":stop")
    two.close()
    server.server_close()
    return spark.createDataFrame(found, "kind string, x int")
