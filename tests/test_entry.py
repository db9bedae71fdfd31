"""The entry file in trees with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = "import __spark_entry__ as e; print(*sorted(e.queries()))"


@pytest.mark.parametrize("gone", [("rosterloom/llm", "tests/llm"),
                                  ("rosterloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_lives_without_the_optional_parts(tmp_path, gone):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=lambda folder, names: {
        n for n in names if n in (".git", "__pycache__")
        or str((Path(folder) / n).relative_to(ROOT)) in gone})
    ran = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tree, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr
    names = ran.stdout.split()
    assert "c2_greedy_dedupe" in names and "pipeline" not in names
    assert not [n for n in names if n.startswith("op")]
    assert not [f for f in (tree / "rosterloom").rglob("*.py") if "import llm" in f.read_text()]
