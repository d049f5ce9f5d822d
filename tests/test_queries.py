"""Registered queries against their SQL on the smallest folder. LICTOR_ALL_QUERIES=1 runs every query with SQL."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connection

FOLDER = "/root/testdata/sf0.001"
SOME = ["co_presence", "win_asymmetry", "hhi", "top3", "vote_contract", "pattern_rules", "risk_index", "text_entities", "entity_exact", "features"]
CHOSEN = sorted(entry.oracle_sql()) if os.environ.get("LICTOR_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    result = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
