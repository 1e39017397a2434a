import importlib

import pytest

SMOKE = "/root/testdata/sf0.001"


def test_entry_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70
    df = entry.entry(spark)
    assert df.columns == ["graph_id", "label", "kind", "seq", "start_token", "path", "end_token"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["list_methods", "arg_op_calls", "subtree_flag", "repo_zscore", "size_filter"])
def test_small_queries_run(spark, name):
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()[name](spark, SMOKE).count() > 0


def test_entry_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, capture_output=True, timeout=120)
    assert done.returncode == 0, done.stderr.decode()[-2000:]
