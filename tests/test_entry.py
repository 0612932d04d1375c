"""The entry without the optional training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries()))"


@pytest.fixture
def copy(tmp_path):
    for name in ("tradewake", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        at = REPO / name
        if at.is_dir():
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif at.exists():
            shutil.copy(at, tmp_path / name)
    return tmp_path


def names(folder):
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True)
    return done.stdout.split(), done.stderr


def test_entry_without_the_folder(copy):
    """Once with the pipeline's file left behind, once without it."""
    for _ in range(2):
        found, warned = names(copy)
        assert "daily_active" in found and not any(n.startswith("op") and n[2].isdigit() for n in found)
        assert "pipeline" not in found and "without the training-data queries" in warned
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


def test_entry_where_a_library_is_absent(copy):
    (copy / "tradewake" / "llm").mkdir()
    (copy / "tradewake" / "llm" / "__init__.py").write_text("")
    (copy / "tradewake" / "llm" / "queries.py").write_text("import no_such_library")
    (copy / "corpus_pipeline.py").write_text("run = ORACLE_SQL = None")
    found, warned = names(copy)
    assert "daily_active" in found and "pipeline" not in found
    assert "no_such_library" in warned
