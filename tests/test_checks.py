"""The check SQL stands on its own: its values are written out in ``checks``, not borrowed from what it checks."""

from __future__ import annotations

import ast
from pathlib import Path

import pytest

from prospectus import checks

CONSTANT_MODULES = ("prospectus.plans", "prospectus.operators", "prospectus.functions")


@pytest.mark.parametrize("path", sorted(Path(checks.__file__).parent.glob("*.py")), ids=lambda p: p.stem)
def test_no_check_imports_constants_of_the_reports(path):
    tree = ast.parse(path.read_text())
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom) and (node.module or "").startswith(CONSTANT_MODULES):
            assert not [name.name for name in node.names if name.name.isupper()], path.name


def test_every_query_has_check_sql_and_reads_given_tables():
    queries, sql = checks.queries(), checks.check_sql()
    assert set(queries) == set(sql)
    for key, text in sql.items():
        assert any(f"FROM {table}" in text or f"JOIN {table}" in text for table in ("customer", "orders", "lineitem", "events", "supplier", "part", "nation", "region")), key
