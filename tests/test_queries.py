"""Every query outside the corpus subpackage against its SQL twin."""

import glob
import os

import duckdb
import pytest

from pactlake.plans import document_queries, portfolio_queries, reply_queries

QUERIES = portfolio_queries.QUERIES | document_queries.QUERIES | reply_queries.QUERIES
ORACLES = portfolio_queries.ORACLES | document_queries.ORACLES | reply_queries.ORACLES


@pytest.fixture(scope="module")
def tables(tiny):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{tiny}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v if isinstance(v, (int, bool, str, type(None))) else str(v)
    return sorted(str([plain(r[i]) for i in order]) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, tables, name):
    out = QUERIES[name](spark, tiny)
    rows = out.collect()
    if name in ORACLES:
        want = tables.sql(ORACLES[name])
        assert _rows(rows, out.columns) == _rows(want.fetchall(), want.columns)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
