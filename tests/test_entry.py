"""What the driver sees."""

import sys


def test_entry_and_names(spark):
    import __spark_entry__ as e

    got = e.entry(spark)
    assert got.columns == ["query", "key", "rank", "similarity"] and got.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_training_package(monkeypatch):
    import importlib

    import __spark_entry__ as e

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("corvane.llm") else real(name, *a))
    assert "vector_topk" in e.queries() and not [q for q in e.queries() if q.startswith("p1_")]
    assert sys.modules
