"""Every core query with a SQL twin gives the same rows on the small tables; the others run."""

import ast
import pathlib

import pytest

import __spark_entry__ as entry
from cairnlake.plans import conditions, corridor, gates, lines, places, routes, trail, warehouse, water

from .conftest import SMALL

MODULES = (places, conditions, trail, warehouse, lines, routes, corridor, water, gates)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, same_rows, name):
    same_rows(QUERIES[name](spark, SMALL), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(entry.__file__).parent / "cairnlake"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
