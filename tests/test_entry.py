"""The entry with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"


@pytest.mark.parametrize("gone", [("lectern/llm", "tests/llm"), ("lectern/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        at = tmp_path / "copy" / name
        if at.is_dir():
            shutil.rmtree(at)
        else:
            at.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, some = out.stdout.split()
    assert int(n) >= 170 and some == "False"
