"""Registered queries against their SQL on the smallest tables, and the independence of the engine from the text operators."""

from __future__ import annotations

import ast
import os
from pathlib import Path

import pytest

from tidemark.plans import details, further, pending, replays, storage, studies  # noqa: F401  (they add queries and SQL)
from tidemark.plans import queries as engine

ROOT = Path(__file__).resolve().parents[1]
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_query_equals_its_sql(spark):
    import duckdb

    from verify import TABLES, rows_of

    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wrong = []
    for name, sql in engine.ORACLE_SQL.items():
        df = engine.QUERIES[name](spark, DATA)
        cur = db.execute(sql)
        columns = [c[0] for c in cur.description]
        if sorted(columns) != sorted(df.columns) or rows_of(df.columns, df.collect()) != rows_of(columns, cur.fetchall()):
            wrong.append(name)
    assert not wrong


def test_windows_have_keys():
    for path in (ROOT / "tidemark").rglob("*.py"):
        assert "Window.orderBy" not in path.read_text(), path


def test_nothing_outside_imports_the_text_operators():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_stability_reads_bars_that_are_made_once(spark):
    assert "l_shipdate" not in engine.QUERIES["lab_stability"](spark, DATA)._jdf.queryExecution().logical().toString()
