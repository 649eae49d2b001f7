"""The entry module with and without the training-corpus subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("spanforge/llm", "tests/llm"), ("spanforge/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    there = tmp_path / "copy"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = there / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=there, env=os.environ | {"PYTHONPATH": str(there)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    names = said.stdout.split()
    assert "mask_replace" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)


def test_queries_are_read_without_a_session():
    code = "import __spark_entry__ as e; from pyspark import SparkContext; print(*e.queries(), *e.oracle_sql()); assert SparkContext._active_spark_context is None"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert {"touching_words", "op1_quality_rules", "op13_alignment", "pipeline"} <= set(said.stdout.split())
