"""Every registered query against its SQL, over whole tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from twinline.catalog import QUERIES as CATALOG

QUERIES = {name: run for name, run in entry.queries().items() if name in CATALOG}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in CATALOG}
NO_SQL = {"met_03_sentence_meteor", "fn_22_word_tokenize"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    rows, problem = compare(spark, con, QUERIES[name], ORACLES.get(name), sf_dir)
    assert problem is None
    assert rows > 0


def test_only_two_queries_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    row = entry.entry(spark).first()
    assert 0 < row["sari"] < 1
