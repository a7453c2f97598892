"""Every query against the SQL that says the same, on the smallest tables."""

import pytest
from harness import DATA, spark_rows, sql_rows

from driftloom.plans import catalog

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, f"{DATA}/{SF}")) == sql_rows(catalog.ORACLES[name], SF)


def test_queries_without_sql(spark):
    """They give a row for each page or document; tests of their own hold them against plain models."""
    folder = f"{DATA}/{SF}"
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"html_strip", "recode_rows"}
    for name, table, key in (("html_strip", "pages", "page_id"), ("recode_rows", "documents", "doc_id")):
        df = catalog.QUERIES[name](spark, folder)
        own = {"page_id": "page_id", "doc_id": "seg_index"}[key]
        assert sorted(r[0] for r in df.select(own).collect()) == sorted(r[0] for r in spark.read.parquet(f"{folder}/{table}.parquet").select(key).collect())
        assert all(isinstance(r[1], str) for r in df.select(own, [c for c in df.columns if c.endswith(("text", "md5", "stripped"))][0]).collect())


def test_scratch_is_cleared(spark):
    import os

    from driftloom import scratch

    table = scratch.written(spark.range(3), "x")
    path = scratch.SCRATCH[-1]
    assert table.count() == 3 and os.path.exists(path) and scratch.shared_folder(spark) == scratch.shared_folder(spark)
    scratch.clear_scratch(spark)
    assert not os.path.exists(path) and not scratch.SCRATCH


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_llm(tmp_path):
    """The entry module works in a copy without the llm subpackage and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "driftloom", tmp_path / "driftloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "bench.py", tmp_path)
    shutil.copytree(root / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert 'squash_plan' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q) and len(q) > 100"
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    # its tests are found, and some that need no session pass
    found = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_session_log.py", "tests/test_decisions.py", "-k", "not spark and (lane or plan or waits or states)"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert found.returncode == 0 and "passed" in found.stdout, found.stdout
    listed = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "--collect-only", "tests"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert listed.returncode == 0, listed.stdout
