"""The registered queries against their SQL, and the entry module without the optional folders."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from attestra.plans.registry import load_all

QUERIES, ORACLES = load_all()

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


def plain(rows):
    norm = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 5) if isinstance(x, float) else x
    return sorted(repr(tuple(norm(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    found = sql.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == plain(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_folders(tmp_path, data):
    for part in ("attestra", "__spark_entry__.py"):
        source = os.path.join(ROOT, part)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / part)
    shutil.rmtree(tmp_path / "attestra/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'slot_prf' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)\n"
    code += "from pyspark.sql import SparkSession\nspark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
    code += f"assert q['status_counts'](spark, {data!r}).count() == 4"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=False)
    assert done.returncode == 0, done.stderr
