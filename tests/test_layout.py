"""Without the training-data operators the rest imports, and nothing in it names them."""

import subprocess
import sys
from pathlib import Path
from shutil import copytree, ignore_patterns

ROOT = Path(__file__).resolve().parent.parent


def test_rest_works_alone(tmp_path):
    copytree(ROOT, tmp_path / "r", ignore=ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q and not set(e.oracle_sql()) - set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)


def test_only_the_entry_names_the_subpackage():
    for p in (ROOT / "spanloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "spanloom.llm" not in p.read_text() and "from .llm" not in p.read_text() and "..llm" not in p.read_text()
