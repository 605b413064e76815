"""The driver's contract, with and without the corpus operators, and every query against its SQL."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tidemark import queries as relational
from tidemark.streaming.select import select_stream

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
DATA = "/root/testdata/sf0.001"


def plain(rows, names):
    key = sorted(range(len(names)), key=lambda i: names[i])
    rounded = lambda v: "nan" if v != v else float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(rounded(r[i]) for i in key) for r in rows), key=str)


@pytest.mark.parametrize("name", list(relational.queries()))
def test_query_equals_its_sql(spark, name):
    base = duckdb.connect()
    for f in os.listdir(DATA):
        base.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = __spark_entry__.queries()[name](spark, DATA)
    want = base.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_stands_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q), list(q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env=env, check=True)


def test_the_dialect_over_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    out = select_stream("SELECT event_type, COUNT(*) AS n, MAX(value) AS m FROM events WHERE value > 10 GROUP BY event_type", events=stream)
    query = out.writeStream.outputMode("complete").format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    want = events.filter("value > 10").groupBy("event_type").agg({"*": "count", "value": "max"}).collect()
    assert sorted(map(tuple, spark.table("told").collect())) == sorted((r[0], r["count(1)"], r["max(value)"]) for r in want)
