"""Every query of the engine against its SQL twin on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pandas as pd
import pytest

from waymark import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, duck, name):
    a, b = plans.QUERIES[name](spark, DATA).toPandas(), duck.execute(plans.ORACLES[name]).fetchdf()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(a), order(b), check_dtype=False)


def test_entry_file_imports():
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries()) and set(plans.ORACLES) <= set(e.oracle_sql())


@pytest.mark.parametrize("gone", [("waymark/llm", "tests/llm"), ("waymark/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_file_without_the_optional_folders(tmp_path, gone):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("waymark", "__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.isdir(f"{root}/{name}"):
            shutil.copytree(f"{root}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path / name)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True) if not name.endswith(".py") else (tmp_path / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'flagship' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
