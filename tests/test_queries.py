"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from mailwarden.plans import io_queries, log_queries, score_oracles, signup_oracles, signup_queries, stream_queries, synthetic_oracles

SF = "/root/testdata/sf0.001"
ORACLES = {**log_queries.ORACLE_SQL, **signup_oracles.ORACLE_SQL, **stream_queries.ORACLE_SQL, **io_queries.ORACLE_SQL, **score_oracles.ORACLE_SQL, **synthetic_oracles.ORACLE_SQL}
QUERIES = {**log_queries.QUERIES, **signup_queries.QUERIES, **stream_queries.QUERIES, **io_queries.QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_agree(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted((repr(tuple(map(plain, r))) for r in got.select(*cols).collect())) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry_imports_without_the_corpus_package(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def blocked(name, *args, **kw):
        if name.startswith("mailwarden.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name="mailwarden.llm" if name.startswith("mailwarden.llm") else name)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", blocked)
    for m in [m for m in sys.modules if m.startswith("mailwarden.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    assert not any(k.startswith("op") or k == "pipeline" for k in entry.queries())
    assert set(QUERIES) <= set(entry.queries())
