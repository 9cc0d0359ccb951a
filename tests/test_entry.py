"""The entry module without the training-data package, and with it."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "carved_m" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_package(tmp_path):
    shutil.copytree(os.path.join(ROOT, "fluvia"), tmp_path / "fluvia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
