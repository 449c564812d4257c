"""The driver contract, and the independence of the engine from the optional subpackage."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).columns == ["hist", "bin", "n"]


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "spindrift").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import | ast.ImportFrom) else []
            module = getattr(node, "module", None) or ""
            assert not any("llm" in n for n in [module, *names]), path
