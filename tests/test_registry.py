"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from hearsay.oracle import SQL
from hearsay.registry import QUERIES
from tools.check_oracle import TABLES, digest, types_match

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["rank", "file", "score"]
    assert 0 <= df.count() <= 3


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(entry.oracle_sql()[name])
    d_rows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert types_match(df, rel) == []
    assert len(s_rows) == len(d_rows)
    assert digest(df.columns, s_rows)[0] == digest(rel.columns, d_rows)[0]


def test_both_tables_of_the_interchange_and_the_store_are_queried():
    assert {"s8_export_terms", "s7_import_terms", "s7_import_whole_index", "s6_scan_document_lists", "s6_scan_documents"} <= set(QUERIES)
