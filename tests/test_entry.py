"""The driver contract holds with and without the optional subpackage and its pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(' '.join(e.queries())); assert set(e.oracle_sql()) <= set(e.queries()); import bench"


def stripped(tmp_path, *gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    run = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return set(run.stdout.split())


@pytest.mark.parametrize("gone", [("lexweave/llm",), ("lexweave/llm", "corpus_pipeline.py")])
def test_engine_queries_are_listed_without_the_subpackage(tmp_path, gone):
    found = stripped(tmp_path, *gone)
    assert "q_connections" in found and "pipeline" not in found and not any(n.startswith("op") for n in found)
