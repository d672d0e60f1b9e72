"""Every registered query against its SQL on the smallest tables, and the package without its training-data part."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from lintquarry.plans import analysis, java_cases, registry, serving, snapshots, sources  # noqa: F401

ROOT = Path(__file__).resolve().parents[1]
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    if name in registry.SQL:
        got = duck.execute(registry.SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted(([plain(r[k]) for k in order] for r in got.fetchall()), key=str)
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert {"task_id", "score", "grade", "passed"} <= set(df.columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_training_data_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
