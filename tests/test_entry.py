"""The registered queries on the smallest tables, against their SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks.compare import connect, differs


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 5


@pytest.mark.parametrize("name", contract.oracle_sql())
def test_query(spark, con, sf_dir, name):
    assert differs(spark, con, name, sf_dir) == ""
