"""Driver contract: entry, queries and their DuckDB oracles agree on the smoke tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMOKE

TABLES = ["documents", "conversations", "events", "benchmark", "labels"]
LIBRARY = sorted(k for k, f in E.queries().items() if f.__module__.startswith("tandem.plans"))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "mean_chars" in df.columns


# held against the tokenizer itself in test_subword.py
NO_SQL = {"sft_subword"}


def test_every_query_has_an_oracle():
    assert set(LIBRARY) - NO_SQL <= set(E.oracle_sql()) <= set(E.queries())


def test_the_library_stands_without_its_subpackage(monkeypatch):
    """Without ``tandem.llm`` neither its queries nor the pipeline, which is part of it, are looked for."""
    real = E._present
    monkeypatch.setattr(E, "_present", lambda name: name != "tandem.llm" and real(name))
    assert set(E.queries()) == set(LIBRARY) and set(E.oracle_sql()) == set(LIBRARY) - NO_SQL


def _norm(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in LIBRARY if n not in NO_SQL])
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMOKE)
    cols = df.columns
    got = [tuple(_norm(r[c]) for c in sorted(cols)) for r in (x.asDict() for x in df.collect())]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in sorted(ocols)]
    want = [tuple(_norm(r[i]) for i in idx) for r in res.fetchall()]
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert sorted(got, key=key) == sorted(want, key=key)
