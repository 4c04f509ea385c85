"""Every registered corpus query runs, and equals its SQL under DuckDB."""

import math

import duckdb
import pytest

from quarry.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    try:
        return repr(round(float(v), 6))
    except (TypeError, ValueError):
        return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    want = duck.execute(oracle_sql()[name])
    assert got == rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs_without_sql(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry_and_driver_contract(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["cwe", "train", "val", "test", "f1"] and out.count() == 8
    assert set(oracle_sql()) <= set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_training_data_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as e

    with monkeypatch.context() as m:
        for name in [n for n in sys.modules if n.startswith("quarry.llm") or n == "corpus_pipeline"]:
            m.delitem(sys.modules, name)
        m.setitem(sys.modules, "quarry.llm", None)
        m.setitem(sys.modules, "corpus_pipeline", None)
        m.delattr("quarry.llm", raising=False)
        importlib.reload(e)
        assert set(e.queries()) == set(queries()) and set(e.oracle_sql()) == set(oracle_sql())
    importlib.reload(e)


def test_nothing_else_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "quarry"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f
