"""The driver's entry module with and without the training-data folders."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=folder, capture_output=True, text=True, check=True)
    return said.stdout.split()


def test_the_rest_stands_alone(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    before = names(tmp_path / "r")
    shutil.rmtree(tmp_path / "r/strandlake/llm", ignore_errors=True)
    (tmp_path / "r/corpus_pipeline.py").unlink(missing_ok=True)
    after = names(tmp_path / "r")
    assert after and not [n for n in after if n == "pipeline" or n.startswith("op")] and set(after) <= set(before)


def test_nothing_else_imports_the_training_data_folder():
    for p in (ROOT / "strandlake").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text(encoding="utf-8")), p
