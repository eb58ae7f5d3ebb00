"""Every query of the key-value engine equals its SQL twin; the entry works without the llm folders."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from chronolith.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


def test_whole_history(spark):
    """The history has every version of every key."""
    want = QUERIES["kv_batch_normalised"](spark, SF)
    got = QUERIES["kv_version_history"](spark, SF)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert got.where("age = 0").count() == want.select("k").distinct().count()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_llm(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/chronolith", tmp_path / "chronolith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(f"{root}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copy(f"{root}/bench.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kv_scan_latest' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    plain = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=plain)
    # Nor do the other tests need them.
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, check=True, env=plain, capture_output=True, text=True)
    assert "test_store.py" in found.stdout and "error" not in found.stdout
    # A pipeline left behind without the subpackage is an import error there, and no query here.
    shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    assert subprocess.run([sys.executable, "-c", "import corpus_pipeline"], cwd=tmp_path, env=plain, capture_output=True).returncode
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=plain)
