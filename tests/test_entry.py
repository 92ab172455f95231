import importlib
import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("codestrata.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "codestrata.llm", None)
    alone = importlib.reload(entry)
    assert "unit_report" in alone.queries() and not any(n.startswith("op") for n in alone.queries())
    monkeypatch.undo()
    importlib.reload(entry)
