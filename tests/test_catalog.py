"""Every catalogue query against its SQL on DuckDB, and the entry point."""

import math
import os

import duckdb
import pytest

from siftwell.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


# Polynomials over GF(2) are beyond SQL; tests/test_functions.py holds them against long division.
NO_SQL = {"rabin_fingerprints"}


def test_all_have_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) | NO_SQL


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in NO_SQL])
def test_query(spark, duck, name):
    ours = catalog.queries()[name](spark, SF)
    theirs = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    expected = sorted(tuple(map(plain, r)) for r in theirs.fetchall())
    assert sorted(tuple(map(plain, r)) for r in ours.select(*columns).collect()) == expected


def test_entry(spark):
    import __spark_entry__

    page = __spark_entry__.entry(spark)
    assert page.columns == ["doc_id", "url", "page_rank", "tfidf", "weighted_value", "preview_name"]
    assert 0 < page.count() <= 10
