"""Every core query beside its SQL on the smallest data."""

from __future__ import annotations

import ast
from pathlib import Path

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from larkspur import queries as core

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = core.queries()[name](spark, DATA)
    cursor = duck.execute(core.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
    assert got == want


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_outside_the_subpackage_imports_it():
    for path in (ROOT / "larkspur").rglob("*.py"):
        if path.relative_to(ROOT / "larkspur").parts[0] != "llm":
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("larkspur.llm") for n in names), path
