import __spark_entry__ as entry


def test_queries_and_sql_go_together():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 30


def test_without_the_optional_subpackage(monkeypatch):
    import importlib

    real = importlib.import_module

    def gone(name, *a):
        if name.startswith("headwater.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name="headwater.llm")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert not any(k.startswith("op") for k in entry.queries()) and "merge_nodes" in entry.queries()
