"""The contract holds with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), 'active_user_cube' in q)"


def _copy(tmp_path, *gone):
    skip = shutil.ignore_patterns(".git", "__pycache__", *gone)
    return Path(shutil.copytree(ROOT, tmp_path / "copy", ignore=skip))


def _ran(folder, *command):
    done = subprocess.run([sys.executable, *command], cwd=folder, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stdout + done.stderr
    return done.stdout


def test_imports_without_the_training_data_operators(tmp_path):
    folder = _copy(tmp_path, "llm", "corpus_pipeline.py")
    n, covered, cube = _ran(folder, "-c", COUNT).split()
    assert int(n) > 190 and covered == cube == "True"


def test_imports_with_the_pipeline_left_behind(tmp_path):
    folder = _copy(tmp_path, "llm")
    assert _ran(folder, "-c", COUNT).split()[1:] == ["True", "True"]
    _ran(folder, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
