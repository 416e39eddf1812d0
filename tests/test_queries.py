"""Every query against its SQL, and the library without the optional subpackage."""

import decimal
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from keyloom.plans import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'; SET memory_limit = '4GB'; SET threads = 4")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


#: Queries over whole vocabularies without SQL; tests/test_abbreviations.py has their steps on small ones.
SLOW = {"candidates", "optimize_dict", "lambda_sweep"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "keyloom", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "keyloom")
    for name in os.listdir(f"{root}/keyloom"):
        if name != "llm":
            os.symlink(f"{root}/keyloom/{name}", tmp_path / "keyloom" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
    assert out.returncode == 0 and int(out.stdout) == len(QUERIES), out.stderr


def test_missing_dependencies_are_not_hidden(tmp_path):
    """Only the subpackage itself may be missing."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_nowhere\n")
    code = "import __spark_entry__ as e\ntry:\n    e.queries()\nexcept ModuleNotFoundError as x:\n    print(x.name)"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
    assert out.stdout.strip() == "a_module_that_is_nowhere", out.stderr
