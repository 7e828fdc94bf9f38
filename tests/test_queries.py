"""Every registered query against its SQL oracle, or for rows where none can be written."""

from __future__ import annotations

import pytest

import oracle_check
from tarmac import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()
# Covered by their parts (the search by top_trials); run by oracle_check.py and the benchmark.
SLOW = {"train_and_evaluate", "compare_selectors", "hyperparameter_search"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_check.connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, sf_dir, name):
    result = oracle_check.compare(spark, con, name, sf_dir, QUERIES, ORACLES)
    assert result.startswith(("ok", "rows only")), result


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert "SevereRate" in df.columns
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
