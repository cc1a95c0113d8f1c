"""The training-data operators are optional: nothing else imports them."""

import ast
import subprocess
import sys
from pathlib import Path

from paperloom.plans import catalog

ROOT = Path(__file__).parent.parent


def test_nothing_else_imports_them():
    for path in (ROOT / "paperloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or "corpus_pipeline" in n for n in names), path


def test_entry_works_without_them(tmp_path):
    import shutil

    shutil.copytree(ROOT / "paperloom", tmp_path / "paperloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL)), "False"], said.stderr[-500:]
