"""The entry module, with or without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from folioflow.plans import catalog


def test_every_document_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def without_optional(tmp_path, *gone):
    """A copy of the repository without some of its parts, and what a fresh interpreter there prints of its queries."""
    copy = tmp_path / "copy"
    shutil.copytree(Path(entry.__file__).parent, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.mark.parametrize("pipeline", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_optional_subpackage(tmp_path, pipeline):
    assert without_optional(tmp_path, "folioflow/llm", "tests/llm", *pipeline) == sorted(catalog.QUERIES)


def test_nothing_else_imports_the_optional_subpackage():
    top = Path(entry.__file__).parent
    others = [p for p in [*top.glob("folioflow/**/*.py"), *top.glob("tests/*.py"), top / "bench.py"] if "llm" not in p.relative_to(top).parts]
    assert not [p for p in others if p.name != "test_entry.py" and "folioflow.llm" in p.read_text()]
