import ast
import importlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tidelog import queries as log_queries

ROOT = Path(__spark_entry__.__file__).parent


def same(a):
    return sorted((tuple("" if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in a), key=str)


@pytest.mark.parametrize("name", sorted(log_queries.SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    got = log_queries.QUERIES[name](spark, sf_dir)
    want = con.sql(log_queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert same(got.select(*columns).collect()) == same(con.sql(f"SELECT {', '.join(columns)} FROM ({log_queries.SQL[name]})").fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[0] == "global_position"


def test_sql_only_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pushdown(spark, sf_dir, tmp_path):
    from tidelog.sources.derived import activity_log

    activity_log(spark, sf_dir).drop("amount").write.parquet(str(tmp_path / "log"))
    from tidelog.operators import scans
    from tidelog.plans.scope import Scope

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = scans.read_events(spark.read.parquet(str(tmp_path / "log")), 5, 10, Scope(("Sales",)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(global_position,5)" in plan and ("EqualTo(bounded_context,Sales)" in plan or "In(bounded_context, [Sales])" in plan) and "TakeOrderedAndProject" in plan


def test_rest_stands_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(log_queries.QUERIES)), "False"], out.stderr


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "tidelog").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path
    assert importlib.util.find_spec("tidelog") is not None
