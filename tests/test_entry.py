"""The library without its optional training-data operators."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]
CHECK = """
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n == "pipeline" or n.startswith("op") and n[2].isdigit() for n in names), names
assert set(e.oracle_sql()) <= names
"""


def without(tmp_path, *gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    return subprocess.run([sys.executable, "-c", CHECK], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True)


def test_entry_without_the_optional_folders(tmp_path):
    out = without(tmp_path, "chronoloom/llm", "tests/llm")
    assert out.returncode == 0, out.stderr


def test_entry_without_the_optional_folders_and_the_pipeline(tmp_path):
    out = without(tmp_path, "chronoloom/llm", "tests/llm", "corpus_pipeline.py")
    assert out.returncode == 0, out.stderr
