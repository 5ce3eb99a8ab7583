"""The driver's contract, with and without the optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 70


@needs_tables
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "loomstone", tmp_path / "loomstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(x.startswith('op') for x in q) and e.oracle_sql(); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr


def test_nothing_else_imports_llm():
    for p in (ROOT / "loomstone").rglob("*.py"):
        if "llm" not in p.parts:
            assert "loomstone.llm" not in p.read_text()
