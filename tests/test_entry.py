"""The driver's contract, with and without the llm subpackage."""

import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns[0] == "o_orderkey"


@pytest.mark.parametrize("gone", ["lamina.llm", "corpus_pipeline"])
def test_imports_without_the_subpackage(monkeypatch, gone):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == gone:
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("lamina.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(sys.modules["lamina"], "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    try:
        fresh = importlib.reload(entry)
        assert not any(n.startswith("op") or n == "pipeline" for n in fresh.queries())
        assert fresh.oracle_sql()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
