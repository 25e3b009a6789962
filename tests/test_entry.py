"""The entry works with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_training_operators(tmp_path):
    for name in ("lexiquarry", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "lexiquarry" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'doc_stats' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_core_does_not_import_training_operators():
    for path in (ROOT / "lexiquarry").rglob("*.py"):
        if "llm" not in path.parts:
            assert "lexiquarry.llm" not in path.read_text(), path
