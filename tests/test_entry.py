"""The driver's entry module works with and without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_the_corpus_folders(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "drawlake", tmp_path / "drawlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (with_pipeline and (ROOT / "corpus_pipeline.py").exists()):
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op') and k[2].isdigit() for k in q), set(e.oracle_sql()) <= set(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    n, pipeline, corpus, known = said.stdout.split()
    assert int(n) > 50 and (pipeline, corpus, known) == ("False", "False", "True")
