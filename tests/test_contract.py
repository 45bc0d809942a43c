"""The driver's contract: names, and the engine without its training-data package."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__spark_entry__.__file__).parent


def test_each_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_rest_works_without_the_training_data_package(tmp_path):
    shutil.copytree(REPO / "arkose", tmp_path / "arkose", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pricing_summary' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True, timeout=60)


def test_nothing_outside_imports_the_package():
    for f in [*REPO.glob("arkose/**/*.py"), REPO / "bench.py"]:
        if "llm" not in f.parts:
            assert "arkose.llm" not in f.read_text()
