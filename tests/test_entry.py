"""The driver contract holds without the corpus operators, with and without the pipeline's file."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert 'tree_count' in q and 'tree_count' in o and callable(e.entry); print(*[n for n in q if n[:2] == 'op' and n[2].isdigit() or n == 'pipeline'])"


def named(folder: str) -> list[str]:
    said = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, env=os.environ | {"PYTHONPATH": folder}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return said.stdout.split()


@pytest.mark.parametrize("gone", [("arbora/llm",), ("arbora/llm", "corpus_pipeline.py")])
def test_without_the_corpus_operators(tmp_path, gone):
    for name in ("__spark_entry__.py", "arbora", "corpus_pipeline.py"):
        source = os.path.join(TOP, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=lambda folder, names: [n for n in names if n == "__pycache__" or os.path.relpath(os.path.join(folder, n), TOP) in gone])
        elif name not in gone and os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    assert named(str(tmp_path)) == []
