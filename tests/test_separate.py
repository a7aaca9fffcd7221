"""The library stands without the subpackage for training data and its pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as entry
names = set(entry.queries())
assert names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(entry.oracle_sql()) <= names
import bench
assert set(bench.QUERIES) <= names
"""


def copy(to: Path, *without: str) -> Path:
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *without)
    return Path(shutil.copytree(ROOT, to / "copy", ignore=skip))


def test_without_folders_and_pipeline(tmp_path):
    subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy(tmp_path, "llm", "corpus_pipeline.py"), check=True, timeout=120)


def test_without_folders(tmp_path):
    subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy(tmp_path, "llm"), check=True, timeout=120)
