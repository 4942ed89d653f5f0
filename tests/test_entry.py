"""The driver's entry module with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
sys.modules["mapengine.llm"] = None
sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
assert e.corpus is None
assert "top_postcodes" in e.queries() and set(e.queries()) == set(e.oracle_sql())
"""


def test_entry_without_the_corpus_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_them():
    files = [p for top in ("mapengine", "checks", "tests") for p in (ROOT / top).rglob("*.py")]
    for path in [*files, ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != "test_entry.py":
            assert "llm" not in path.read_text(), path
