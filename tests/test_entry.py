import builtins
import importlib
import sys

import __spark_entry__


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_text_operators(monkeypatch):
    real = builtins.__import__

    def guarded(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "corpus_pipeline" or name.startswith("ohmgraph.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", guarded)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() and not [q for q in entry.queries() if q.startswith("op")]
    monkeypatch.undo()
