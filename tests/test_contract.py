"""The driver's contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from conftest import ROOT

ASK = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
names, sql = set(e.queries()), set(e.oracle_sql())
assert sql <= names, sql - names
assert e.entry(spark).count() == 15
print("corpus" if "pipeline" in names else "rest", len(names))
"""


@pytest.mark.parametrize("whole", [True, False])
def test_queries_of_a_copy(tmp_path, whole):
    left_out = [] if whole else ["llm"]
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *left_out))
    copy = tmp_path / "copy"
    has = (copy / "plotweave" / "llm").exists()
    assert has <= whole and (copy / "corpus_pipeline.py").exists() >= has
    ran = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True,
                         timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert ran.stdout.split()[0] == ("corpus" if has else "rest")


def test_nothing_else_imports_the_corpus_operators():
    for f in Path(ROOT, "plotweave").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "plotweave.llm" not in f.read_text(), f
