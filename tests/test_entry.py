"""The driver's entry without a session, and without the subpackage that may be deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(set(e.queries()) - set(e.oracle_sql())))"


def entry(folder):
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, oracles, rest = done.stdout.split(" ", 2)
    return int(queries), int(oracles), rest


def test_entry_needs_no_session_and_no_llm(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.pyc"))
    shutil.rmtree(copy / "graphloom" / "llm", ignore_errors=True)
    (copy / "graphloom" / "llm" / "__pycache__").mkdir(parents=True)  # as deleting the sources alone leaves it
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    queries, oracles, rest = entry(copy)
    assert queries == oracles > 100 and rest.strip() == "[]"
    assert entry(REPO)[0] >= queries
