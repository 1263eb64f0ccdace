"""The entry module: names, SQL for registered names only, and the guard around the corpus operators."""

import importlib
import sys

import __spark_entry__ as entry


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"aot_by_event_type", "contract_coverage", "recorder_stream"} <= set(entry.queries())


def test_entry_works_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("seriata.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "seriata.llm", None)
    importlib.reload(entry)
    assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    assert "aot_by_event_type" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
