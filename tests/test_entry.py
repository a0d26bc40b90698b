"""The driver's entry, with and without the subpackage of training-data operators."""
from __future__ import annotations

import sys

import __spark_entry__ as entry
from lectern.plans import catalog


def test_queries_and_sql_have_the_same_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.queries()) <= set(entry.queries())


def test_what_cannot_be_imported_is_left_out(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("lectern.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lectern.llm.queries", None)
    assert entry.queries() == catalog.queries() and entry.oracle_sql() == catalog.oracle_sql()


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
