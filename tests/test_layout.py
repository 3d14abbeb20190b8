"""The package stands without its llm part; every query is registered with a callable."""

import ast
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_core_does_not_import_llm():
    for p in (ROOT / "tantu").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_entry():
    import __spark_entry__ as entry

    assert all(map(callable, entry.queries().values())) and set(entry.oracle_sql()) <= set(entry.queries())
