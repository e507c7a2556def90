"""The library without its corpus operators: a copy of the tree from which their folders are deleted."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sorted(n for n in q if n[:2] == 'op' or n == 'pipeline'))"


def _copy(to: Path) -> Path:
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json", "*.txt")
    return Path(shutil.copytree(ROOT, to / "repo", ignore=skip))


@pytest.mark.parametrize("rest", ["pipeline stays", "pipeline goes", "caches stay"])
def test_entry_without_the_corpus_operators(tmp_path, rest):
    repo = _copy(tmp_path)
    for folder in ("lynceus/llm", "tests/llm"):
        if (repo / folder).exists():
            shutil.rmtree(repo / folder)
    if rest == "pipeline goes" and (repo / "corpus_pipeline.py").exists():
        (repo / "corpus_pipeline.py").unlink()
    if rest == "caches stay":
        (repo / "lynceus/llm/__pycache__").mkdir(parents=True)
    env = os.environ | {"PYTHONPATH": str(repo), "PYTHONDONTWRITEBYTECODE": "1"}
    got = subprocess.run([sys.executable, "-c", CODE], cwd=repo, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr
    number, names = got.stdout.split(" ", 1)
    assert int(number) > 100 and names.strip() == "[]"


def test_nothing_else_imports_the_corpus_operators():
    for path in [*(ROOT / "lynceus").rglob("*.py"), *(ROOT / "tests").glob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != Path(__file__).name:
            assert "lynceus.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
