"""Queries whose Python workers cannot import the package, and columns whose names need quotes."""

import os
import subprocess
import sys

import corpus_pipeline as cp
from keyloom.llm import common

ROOT = os.path.dirname(os.path.abspath(cp.__file__))
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from keyloom import session

spark = session.local(4)
seen = spark.range(1).mapInArrow(lambda bs: (b for b in bs if not __import__("importlib").util.find_spec("keyloom")), "id long").count()
assert seen == 1, "the workers see the package"
for name, query in entry.queries().items():
    if name == "pipeline" or name.startswith("op") and name[2].isdigit():
        print(name, len(query(spark, "/root/testdata/sf0.001").collect()))
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-4000:]
    assert len([line for line in out.stdout.splitlines() if line.startswith(("op", "pipeline"))]) == 11


def test_stages_with_columns_of_any_name(spark):
    rows = [(1, "a b c", "en", "s", 5, 1, 2, 3, 4), (2, "password=abcdefabcdef12 x", "en", "s", 9, 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `x``y` int, key int, __r int")
    for _, stage in cp.STAGES[:-1]:
        after = common.stored(stage(spark, docs, "/root/testdata/sf0.001"), "names")
        assert after.columns == docs.columns
        docs = after
    assert cp.STAGES[-1][1](spark, docs, "").count() >= 0
