"""The entry point without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 100 and set(o) <= set(q) and "pipeline" not in q and not any(k.startswith("op") and "_" in k and k[2:3].isdigit() for k in q)
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_operators(tmp_path, pipeline):
    """The subpackage may go with or without the pipeline's file; an empty folder of it may stay."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "tests"))
    assert not (copy / "lamina" / "llm").exists()
    if not pipeline and (copy / "corpus_pipeline.py").exists():
        os.remove(copy / "corpus_pipeline.py")
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
