"""The library without its training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1') or k == 'pipeline' for k in e.queries()))"


@pytest.mark.parametrize("gone", [["loam/llm", "tests/llm", "corpus_pipeline.py"], ["loam/llm", "tests/llm"]])
def test_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    queries, oracles, llm = out.stdout.split()
    assert int(queries) > 95 and int(oracles) > 95 and llm == "False"
