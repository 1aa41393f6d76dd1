"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyweave.queries import ORACLE_SQL, QUERIES

def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:19].removesuffix(" 00:00:00")
    return float(f"{v:.12g}") if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    rows = got.collect()
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda rows, names: sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rows), key=repr)
    assert key(rows, got.columns) == key(want.fetchall(), columns)


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_folder(monkeypatch):
    """Whatever keeps that folder from being imported drops its queries alone."""
    import sys

    for name in [n for n in sys.modules if n.startswith("tallyweave.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    with pytest.warns(UserWarning, match="without the queries"):
        assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL)


def test_no_query_reads_a_part():
    """Every query has SQL but those that tests of their own hold."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"script_addresses"}
