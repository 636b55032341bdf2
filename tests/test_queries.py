"""Every query with SQL against DuckDB on the smallest tables; the others have rows."""

import pytest

from compare import assert_same
from tallyrook.plans import data_queries, edit_queries, eval_queries, ledger_queries, misc_queries, sheet_queries, word_queries

PLANS = [sheet_queries, edit_queries, eval_queries, ledger_queries, word_queries, data_queries, misc_queries]
ORACLES = {name: sql for p in PLANS for name, sql in p.ORACLES.items()}
QUERIES = {name: f for p in PLANS for name, f in p.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_all_have_sql_and_names_are_unique():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) == sum(len(p.QUERIES) for p in PLANS)


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
