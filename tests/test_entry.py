"""The driver's contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(code, cwd, path=""):
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, timeout=240, check=True).stdout


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_without_the_corpus_part(tmp_path):
    shutil.copytree(ROOT / "parcelforge", tmp_path / "parcelforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = run("import __spark_entry__ as e; q = e.queries(); print(len(q), 'a2_price_band' in q, any(n.startswith('op') for n in q))", tmp_path)
    assert out.split()[1:] == ["True", "False"]


def test_workers_elsewhere(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["f24_page_facts"](spark, "/root/testdata/sf0.001").count())
"""
    assert int(run(code, tmp_path).rpartition("ROWS")[2]) > 0
