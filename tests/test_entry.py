"""The driver contract, with and without the text subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_query(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_works_without_the_text_subpackage(tmp_path):
    shutil.copytree(ROOT / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'lj_energy' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_works_without_what_the_text_subpackage_needs():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; assert 'lj_energy' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_text_subpackage():
    for path in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "graphloom.llm" not in path.read_text(), path
