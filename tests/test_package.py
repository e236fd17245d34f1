import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent / "tabulon"


def test_nothing_outside_imports_the_subpackage():
    for p in ROOT.rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("tabulon.llm") for n in names), p


def test_entry_lists_queries_and_oracles():
    q = entry.queries()
    assert {"profile_columns", "p1_found", "p2_found", "p3_found", "p6_found"} <= set(q)
    assert set(entry.oracle_sql()) <= set(q)
