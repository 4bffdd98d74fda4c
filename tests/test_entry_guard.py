"""The entry module on a copy of the repository without the training-data folders, with and without the pipeline file."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; n = e.queries(); print(len(n), sum(k.startswith('op') and '_' in k and k[2].isdigit() for k in n), 'pipeline' in n)"


@pytest.mark.parametrize("pipeline_file", [True, False])
def test_entry_imports_without_the_optional_folders(tmp_path, pipeline_file):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "*.txt")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    if not pipeline_file:
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "copy")}
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, check=True)
    total, numbered, pipeline = out.stdout.split()
    assert int(total) > 100 and numbered == "0" and pipeline == "False"
