"""The entry point with and without the part that can be taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_entry_imports_without_the_text_operators(tmp_path, pipeline_stays):
    left_out = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline_stays else ["corpus_pipeline.py"]))
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    assert not (copy / "paperloom/llm").exists()
    said = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 180 and said[1:] == ["False", "False", "True"]
