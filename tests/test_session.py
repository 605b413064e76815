"""Tables that change: DDL, DML, loaders, transactions, indices, commands, server."""

import datetime
import json
import random
import threading

import pytest

from tidemark import errors as er
from tidemark.formatting import arrow_bytes, boxed, json_lines
from tidemark.session import Session


@pytest.fixture
def session(spark, tmp_path):
    with Session(spark, str(tmp_path / "w")) as s:
        yield s


def rows(s, text):
    return [tuple(r) for r in s.execute(text).collect()]


def account(s, values=((1, 10), (2, 20))):
    s.execute("CREATE TABLE t (id INT, bal DECIMAL)")
    s.execute("INSERT INTO t (id, bal) VALUES " + ", ".join(f"({a}, {b})" for a, b in values))


def test_types_round_trip(session):
    session.execute("CREATE TABLE t (i INT, l LONG, d DECIMAL, c CHAR(4), dt DATE)")
    session.execute(f"INSERT INTO t (i, l, d, c, dt) VALUES ({-2**31}, {2**63 - 1}, -0.5, 'abcdef', '2020-02-29'), (2.9, -1, 3, '007', DATE '1995-01-05'), (0, 0, .5, 'a b', '9999-12-31')")
    day = datetime.date
    assert rows(session, "SELECT * FROM t ORDER BY i") == [(-(2**31), 2**63 - 1, -0.5, "abcd", day(2020, 2, 29)), (0, 0, 0.5, "a b", day(9999, 12, 31)), (2, -1, 3.0, "007", day(1995, 1, 5))]
    assert rows(session, "SELECT c FROM t WHERE dt <= '2020-02-29' AND c < 'b' ORDER BY c") == [("007",), ("abcd",)]


def test_ddl_and_insert_rules(session):
    session.execute("CREATE TABLE t (a INT, b CHAR(3) NULL)")
    session.execute("CREATE TABLE IF NOT EXISTS t (z INT)")
    for text, error in [
        ("CREATE TABLE t (a INT)", er.TableExists), ("CREATE TABLE u (a INT, a INT)", er.AnalysisError), ("CREATE TABLE u (a INT, A INT)", er.AnalysisError), ("INSERT INTO t (a) VALUES (1)", er.ColumnCannotBeNull), ("INSERT INTO t (a, z) VALUES (1, 2)", er.ColumnNotFound),
        ("INSERT INTO q (a) VALUES (1)", er.TableNotFound), ("INSERT INTO t (a, b) VALUES (1)", er.AnalysisError), ("INSERT INTO t (a, b) VALUES ('x', 'y')", er.AnalysisError), ("SELECT * FROM q", er.TableNotFound),
        ("UPDATE t SET z = 1", er.ColumnNotFound), ("DELETE FROM q", er.TableNotFound), ("CREATE INDEX i ON t(z)", er.ColumnNotFound), ("COMMIT", er.NotInTransaction), ("ABORT", er.NotInTransaction),
    ]:
        with pytest.raises(error):
            session.execute(text)
    session.execute("INSERT INTO t (b, a) VALUES ('x', 1)")
    assert rows(session, "SELECT a, b FROM t") == [(1, "x")]


def test_random_changes_against_a_list(session):
    rnd, model = random.Random(3), []
    session.execute("CREATE TABLE t (id INT, g INT, v DECIMAL)")
    for step in range(25):
        g = rnd.randint(0, 3)
        action = rnd.choice(["insert", "insert", "update", "delete"])
        if action == "insert":
            new = [(rnd.randint(0, 50), rnd.randint(0, 3), float(step)) for _ in range(3)]
            session.execute("INSERT INTO t (id, g, v) VALUES " + ", ".join(map(str, new)))
            model += new
        elif action == "update":
            session.execute(f"UPDATE t SET v = v + 1, g = g * 2 WHERE g = {g} OR id < 5")
            assert session.last.rows == sum(r[1] == g or r[0] < 5 for r in model)
            model = [(a, b * 2, c + 1) if b == g or a < 5 else (a, b, c) for a, b, c in model]
        else:
            session.execute(f"DELETE FROM t WHERE g = {g} AND id > 30")
            model = [r for r in model if not (r[1] == g and r[0] > 30)]
    assert sorted(rows(session, "SELECT * FROM t")) == sorted(model)
    assert rows(session, "SELECT cardinality FROM system_table_statistics") == [(len(model),)]
    session.compact("t", 2)
    assert sorted(rows(session, "SELECT * FROM t")) == sorted(model)


def test_nulls_stay_out_of_conditions(session, spark):
    session.create_from("t", spark.createDataFrame([(1, None), (2, -5), (3, 7)], "id int, x int"))
    session.execute("DELETE FROM t WHERE x < 0")
    session.execute("UPDATE t SET x = 0 WHERE x > 0")
    assert rows(session, "SELECT id, x FROM t ORDER BY x") == [(1, None), (3, 0)]


def test_only_files_with_hits_are_rewritten(session):
    account(session, [(1, 1)])
    session.execute("INSERT INTO t (id, bal) VALUES (2, 2)")
    before = set(session.store.latest().table("t").files)
    session.execute("UPDATE t SET bal = 5 WHERE id = 2")
    after = set(session.store.latest().table("t").files)
    assert len(before & after) == 1 and len(after) == 2


# ---- transactions


def two(spark, tmp_path):
    a, b = Session(spark, str(tmp_path / "w")), Session(spark, str(tmp_path / "w"))
    account(a)
    return a, b


def test_own_writes_snapshot_and_abort(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.execute("BEGIN")
    a.execute("INSERT INTO t (id, bal) VALUES (3, 30)")
    a.execute("UPDATE t SET bal = bal + 1 WHERE id >= 2")
    a.execute("DELETE FROM t WHERE id = 1")
    assert sorted(rows(a, "SELECT * FROM t")) == [(2, 21.0), (3, 31.0)]
    assert sorted(rows(b, "SELECT * FROM t")) == [(1, 10.0), (2, 20.0)]
    a.execute("ABORT")
    assert sorted(rows(a, "SELECT * FROM t")) == [(1, 10.0), (2, 20.0)]
    b.execute("BEGIN")
    assert rows(b, "SELECT COUNT(*) FROM t") == [(2,)]
    a.execute("DELETE FROM t")
    assert rows(b, "SELECT COUNT(*) FROM t") == [(2,)]  # its snapshot
    b.execute("COMMIT")  # has only read
    assert rows(b, "SELECT COUNT(*) FROM t") == [(0,)]


def test_write_write(spark, tmp_path):
    a, b = two(spark, tmp_path)
    for s in (a, b):
        s.execute("BEGIN")
        s.execute("UPDATE t SET bal = bal + 1 WHERE id = 1")
    a.execute("COMMIT")
    with pytest.raises(er.TransactionAborted):
        b.execute("COMMIT")
    assert sorted(rows(b, "SELECT * FROM t")) == [(1, 11.0), (2, 20.0)]


def test_write_skew(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.execute("CREATE TABLE log (id INT)")
    for s, i in ((a, 1), (b, 2)):
        s.execute("BEGIN")
        rows(s, "SELECT SUM(bal) FROM t")
        s.execute(f"INSERT INTO t (id, bal) VALUES ({i + 10}, -15)")
    a.execute("COMMIT")
    with pytest.raises(er.TransactionAborted):
        b.execute("COMMIT")


def test_phantoms_and_rows_that_do_not_matter(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.execute("BEGIN")
    assert rows(a, "SELECT COUNT(*) FROM t WHERE bal > 100") == [(0,)]
    a.execute("INSERT INTO t (id, bal) VALUES (4, 1)")
    b.execute("INSERT INTO t (id, bal) VALUES (5, 50)")  # not in the range that a has read
    a.execute("COMMIT")
    a.execute("BEGIN")
    assert rows(a, "SELECT COUNT(*) FROM t WHERE t.bal > 100") == [(0,)]
    a.execute("INSERT INTO t (id, bal) VALUES (6, 1)")
    b.execute("INSERT INTO t (id, bal) VALUES (7, 500)")
    with pytest.raises(er.TransactionAborted):
        a.execute("COMMIT")
    assert sorted(r[0] for r in rows(a, "SELECT id FROM t")) == [1, 2, 4, 5, 7]


def test_inserts_and_other_tables_do_not_conflict(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.execute("CREATE TABLE u (id INT)")
    a.execute("BEGIN")
    a.execute("INSERT INTO t (id, bal) VALUES (3, 1)")
    b.execute("INSERT INTO t (id, bal) VALUES (4, 1)")
    b.execute("INSERT INTO u (id) VALUES (1)")
    a.execute("COMMIT")
    assert rows(a, "SELECT COUNT(*) FROM t") == [(4,)]
    for s in (a, b):
        s.execute("BEGIN")
        s.execute("CREATE TABLE same (id INT)")
    a.execute("COMMIT")
    with pytest.raises(er.TransactionAborted):
        b.execute("COMMIT")


def test_concurrent_sessions_lose_nothing(spark, tmp_path):
    a, _ = two(spark, tmp_path)
    errors = []

    def work(k):
        try:
            s = Session(spark, str(tmp_path / "w"))
            for i in range(3):
                s.execute(f"INSERT INTO t (id, bal) VALUES ({100 * k + i}, 1)")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(1, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and rows(a, "SELECT COUNT(*) FROM t") == [(14,)]


def test_a_failed_statement_changes_nothing_and_state_is_saved(spark, tmp_path, monkeypatch):
    from tidemark.sources import store

    monkeypatch.setattr(store, "KEEP", 4)
    a, _ = two(spark, tmp_path)
    for i in range(5):
        a.execute(f"INSERT INTO t (id, bal) VALUES ({i}, 0)")
    with pytest.raises(er.EngineError):
        a.execute("INSERT INTO t (id, bal) VALUES (1, 'x')")
    fresh = Session(spark, str(tmp_path / "w"))
    assert rows(fresh, "SELECT COUNT(*) FROM t") == [(7,)]
    assert list((tmp_path / "w" / "_log").glob("*.state.json"))


# ---- indices


def test_index_lays_out_and_skips(session, spark):
    session.create_from("t", spark.range(4000).selectExpr("cast((id * 7919) % 4000 as int) as id", "cast(id % 10 as int) as g"))
    session.execute("CREATE INDEX i ON t(id)")
    for where, n in [("id < 10", 10), ("id <= 10", 11), ("id > 3990", 9), ("id >= 3990", 10), ("id = 77", 1), ("id = 5 OR id = 5 OR id > 3998", 2)]:
        assert rows(session, f"SELECT COUNT(*) FROM t WHERE {where}") == [(n,)]
    state = session.store.latest().table("t")
    spans = [session.store.frame(state, [f]).selectExpr("min(id)", "max(id)").first() for f in state.files]
    spans = sorted(map(tuple, spans))
    assert all(spans[k][1] < spans[k + 1][0] for k in range(len(spans) - 1))  # files do not overlap
    with pytest.raises(er.IndexExists):
        session.execute("CREATE INDEX i ON t(g)")
    with pytest.raises(er.IndexExists):
        session.execute("CREATE INDEX j ON t(id)")


def test_unique_is_kept_if_asked_for(session):
    account(session)
    session.execute("CREATE UNIQUE INDEX i ON t(id)")
    session.execute("INSERT INTO t (id, bal) VALUES (1, 0)")
    session.execute("DELETE FROM t WHERE bal = 0")
    session.execute(":set enforce_unique 1")
    with pytest.raises(er.UniqueViolation):
        session.execute("INSERT INTO t (id, bal) VALUES (1, 0)")
    assert rows(session, "SELECT COUNT(*) FROM t") == [(2,)]


def test_index_and_changes_read_only_files_in_range(session, spark):
    session.create_from("t", spark.range(4000).selectExpr("cast((id * 7919) % 4000 as int) as id", "id % 10 = 0 as odd", "date_add(date'2020-01-01', cast(id as int)) as d").drop("odd"))
    session.execute("CREATE INDEX i ON t(id)")
    session.compact("t", 6)
    state = session.store.latest().table("t")
    assert len(state.files) >= 4 and set(state.ranges) == set(state.files)
    read = lambda text: len(session.execute(text).inputFiles())
    assert read("SELECT id FROM t") == len(state.files)
    assert read("SELECT id FROM t WHERE id < 10") == 1 and read("SELECT id FROM t WHERE 10 > id AND d > '1999-01-01'") == 1
    assert read("SELECT a.id FROM t a JOIN t b ON a.id = b.id WHERE a.id = 5 AND b.id >= 0") == len(state.files) and read("SELECT id FROM t WHERE id > 99999") == 0
    assert rows(session, "SELECT COUNT(*) FROM t WHERE id > 99999 OR id = 3") == [(1,)]
    session.execute(":set no_optimization 1")
    assert read("SELECT id FROM t WHERE id < 10") == len(state.files)
    session.execute(":set no_optimization 0")
    session.execute("UPDATE t SET id = id + 5000 WHERE id < 10")
    after = session.store.latest().table("t")
    assert len(set(state.files) - set(after.files)) == 1
    fresh = Session(spark, session.store.root)
    assert rows(fresh, "SELECT COUNT(*) FROM t WHERE id >= 5000") == [(10,)] and fresh.store.latest().table("t").ranges == after.ranges


def test_ranges_rule_out_only_what_cannot_hold(session, spark):
    rnd = random.Random(5)
    values = [None if rnd.random() < 0.2 else rnd.randint(-5, 5) for _ in range(40)]
    texts = [None if rnd.random() < 0.2 else rnd.choice(["", "a", "b c", "é", "漢", "10"]) for _ in range(40)]
    days = [None if rnd.random() < 0.2 else datetime.date(2020, 1, rnd.randint(1, 9)) for _ in range(40)]
    reals = [rnd.choice([None, float("nan"), -0.5, 1.5, 2.0]) for _ in range(40)]
    session.create_from("t", spark.createDataFrame(list(zip(values, texts, days, reals, strict=True)), "x int, c string, d date, r double").repartition(9))
    plain = {}
    tests = [f"{c} {s} {v}" for c, vs in (("x", (-3, 0, 2.5, 99)), ("c", ("'a'", "'10'", "'zz'")), ("d", ("'2020-01-05'", "DATE '2021-01-01'")), ("r", (1.5, 7, -1))) for v in vs for s in ("=", "<>", "<", "<=", ">", ">=")]
    tests += ["3 < x AND c = 'a'", "x = 5 OR d = '2020-01-02'", "x < r", "1 = 1", "(x > 4 OR x < -4) AND (c >= 'b' OR r > 1.0)"]
    for t in tests:
        plain[t] = sorted(map(str, rows(session, f"SELECT * FROM t WHERE {t}")))
    for c in "xcdr":
        session.execute(f"CREATE INDEX by_{c} ON t({c})")
    for t in tests:
        assert sorted(map(str, rows(session, f"SELECT * FROM t WHERE {t}"))) == plain[t], t


def test_unique_holds_between_sessions(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.execute("CREATE UNIQUE INDEX i ON t(id)")
    for s in (a, b):
        s.execute(":set enforce_unique 1")
        s.execute("BEGIN")
    a.execute("INSERT INTO t (id, bal) VALUES (99, 1), (5, 5)")
    b.execute("INSERT INTO t (id, bal) VALUES (98, 1), (99, 2)")
    a.execute("COMMIT")
    with pytest.raises(er.TransactionAborted):
        b.execute("COMMIT")
    for s, i in ((a, 60), (b, 61)):
        s.execute("BEGIN")
        s.execute(f"INSERT INTO t (id, bal) VALUES ({i}, 1)")
    a.execute("COMMIT")
    b.execute("COMMIT")  # other values
    for bad in ("INSERT INTO t (id, bal) VALUES (60, 1)", "INSERT INTO t (id, bal) VALUES (70, 1), (70, 2)", "UPDATE t SET id = 99 WHERE id = 61"):
        with pytest.raises(er.UniqueViolation):
            b.execute(bad)
    assert sorted(r[0] for r in rows(a, "SELECT id FROM t")) == [1, 2, 5, 60, 61, 99]
    c, e = Session(spark, a.store.root), Session(spark, a.store.root)
    for s in (c, e):
        s.execute(":set enforce_unique 1")
    c.execute("CREATE TABLE u (id INT)")
    c.execute("BEGIN")
    e.execute("BEGIN")
    c.execute("CREATE UNIQUE INDEX j ON u(id)")
    e.execute("INSERT INTO u (id) VALUES (1), (1)")
    c.execute("COMMIT")
    with pytest.raises(er.TransactionAborted):
        e.execute("COMMIT")


def test_a_join_reads_what_its_conditions_say(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.execute("CREATE TABLE u (id INT)")
    a.execute("INSERT INTO u (id) VALUES (1)")
    a.execute("BEGIN")
    rows(a, "SELECT t.id FROM t JOIN u ON t.id = u.id WHERE bal > 100")
    a.execute("INSERT INTO u (id) VALUES (7)")
    b.execute("INSERT INTO t (id, bal) VALUES (9, 50)")
    a.execute("COMMIT")
    a.execute("BEGIN")
    rows(a, "SELECT x.id FROM t x, t y WHERE x.bal > 100 AND y.bal > 1000 AND x.id = y.id")
    a.execute("INSERT INTO u (id) VALUES (8)")
    b.execute("INSERT INTO t (id, bal) VALUES (10, 500)")
    with pytest.raises(er.TransactionAborted):
        a.execute("COMMIT")


# ---- loaders


def test_tbl_and_sql_files(session, tmp_path):
    (tmp_path / "movie.sql").write_text("CREATE TABLE movie (id INT, name CHAR(8),\nyear INT, rating DECIMAL, released DATE);\n-- INSERT INTO nothing;\n/*\nDROP it;\n*/\nINSERT INTO movie (id, name, year, rating, released)\nVALUES (1, 'Alien', 1979, 8.5, '1979-05-25');\nremark #\n")
    session.load(str(tmp_path / "movie.sql"))
    (tmp_path / "movie.tbl").write_text("2|Brazil and more|1985|7.9|1985-02-20|\n3|short\n4|Cube|1997|7.2|1997-09-09|extra|fields|\n")
    session.load(str(tmp_path / "movie.tbl"))
    assert rows(session, "SELECT id, name, released FROM movie ORDER BY id") == [(1, "Alien", datetime.date(1979, 5, 25)), (2, "Brazil a", datetime.date(1985, 2, 20)), (4, "Cube", datetime.date(1997, 9, 9))]
    (tmp_path / "bad.sql").write_text("INSERT INTO movie (id, name, year, rating, released) VALUES (9, 'x', 1, 1, '2000-01-01');\nINSERT INTO none (id) VALUES (1);\n")
    with pytest.raises(er.TableNotFound):
        session.load(str(tmp_path / "bad.sql"))
    assert rows(session, "SELECT COUNT(*) FROM movie") == [(3,)]
    with pytest.raises(er.EngineError):
        session.load("movie.csv")


# ---- commands and results


def test_commands(session):
    account(session)
    session.execute("CREATE INDEX i ON t(id)")
    assert rows(session, ":show tables") == [("t",)]
    assert rows(session, ":SHOW columns") == [("t", "id"), ("t", "bal")]
    assert rows(session, ":show indices") == [("t", "id", "i", 0, 1)]
    assert rows(session, ":stats t")[0][:3] == ("t", 2, 2)
    plan = json.loads(rows(session, ":explain plan SELECT id, COUNT(*) AS n FROM t WHERE bal > 5 GROUP BY id ORDER BY id LIMIT 3;")[0][0])
    names = []
    while plan:
        names.append(plan["name"])
        plan = plan["childs"][0] if plan["childs"] else None
    assert names == ["Projection", "Limit", "Order By", "Aggregation", "Selection", "TableScan"]
    assert rows(session, ":get enable_hash_join") == [("enable_hash_join", 0)]
    assert rows(session, ":set enable_hash_join 1") == [("enable_hash_join", 1, 0)]
    assert "ShuffledHashJoin" in rows(session, ":explain SELECT a.id FROM t a JOIN t b ON a.id = b.id")[0][1]
    assert len(rows(session, ":get")) >= 10
    for bad in (":show x", ":explain", ":set lru_k", ":set lru_k x", ":stats", ":stats q", ":nothing", ":get a-b"):
        with pytest.raises(er.CommandError):
            session.execute(bad)
    for bad in (":get nothing", ":set lru_k 3"):
        with pytest.raises(er.OptionError):
            session.execute(bad)


def test_system_tables_can_be_queried(session):
    session.execute("CREATE TABLE t (a INT, b CHAR(9) NULL, c DATE)")
    found = rows(session, "SELECT c.name, c.type_id, c.length, c.is_nullable FROM system_columns c, system_tables t WHERE c.table_id = t.id AND t.name = 't' ORDER BY c.id")
    assert found == [("a", 0, 4, 0), ("b", 3, 9, 1), ("c", 4, 4, 0)]
    assert rows(session, "SELECT COUNT(*) FROM system_indices") == [(0,)]


def test_results(session):
    account(session)
    df = session.execute("SELECT id, bal FROM t ORDER BY id")
    assert boxed(df).split("\n")[1] == "│ id │ bal  │" and len(boxed(df).split("\n")) == 6
    assert [json.loads(x) for x in json_lines(df)] == [{"id": 1, "bal": 10.0}, {"id": 2, "bal": 20.0}]
    import pyarrow as pa

    assert pa.ipc.open_stream(arrow_bytes(df)).read_all().to_pylist() == [{"id": 1, "bal": 10.0}, {"id": 2, "bal": 20.0}]
    seen = []
    assert session.each("SELECT id FROM t ORDER BY id", seen.append, lambda s: seen.append(s.names)) == 2
    assert seen[0] == ["id"] and [r[0] for r in seen[1:]] == [1, 2]


def test_statistics_and_console(session, capsys):
    from tidemark.__main__ import say

    account(session)
    assert session.last.rows == 2 and session.last.execution_ms > 0
    assert session.each("SELECT id FROM t", lambda _: None) == 2 == session.last.rows and session.last.execution_ms > 0 and session.last.planning_ms > 0
    assert say(session, ":set print_execution_statistics 1") and say(session, "SELECT id FROM t ORDER BY id")
    told = capsys.readouterr().out.split("\n")
    assert told[-7] == "│ id │" and told[-2].startswith("2 rows, planned in ")
    assert say(session, ":set enable_index_scan 1") and "changes nothing" in capsys.readouterr().out
    assert say(session, ":set check_final_plan 1") and say(session, "INSERT INTO t (id, bal) VALUES (3, 1)") and "ok, 1 rows" in capsys.readouterr().out
    assert not say(session, "SELECT nothing FROM t") and "error" in capsys.readouterr().err


def test_server(spark, tmp_path):
    from tidemark.server import Client, Server

    server = Server(spark, str(tmp_path / "w"), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = Client(port=server.server_address[1])
    assert client.send("CREATE TABLE t (id INT)") == {"kind": "done"}
    client.send("INSERT INTO t (id) VALUES (5)")
    assert client.send("SELECT id AS x FROM t") == {"kind": "rows", "columns": ["x"], "rows": [[5]]}
    assert client.send("SELECT nothing FROM t")["kind"] == "error"
    client.send("BEGIN")
    client.send("DELETE FROM t")
    client.close()
    again = Client(port=server.server_address[1])
    assert again.send("SELECT COUNT(*) AS n FROM t")["rows"] == [[1]]  # what was open is gone
    assert again.send(":stop") == {"kind": "closed"}
    again.close()
    server.server_close()
