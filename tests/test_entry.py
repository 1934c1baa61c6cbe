"""The contract's functions, with or without the text operators."""

import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_flagship(spark):
    assert [tuple(r) for r in entry.entry(spark).collect()] == [("all", 167.1953125)]


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "linkscape").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "linkscape.llm" not in path.read_text(), path
