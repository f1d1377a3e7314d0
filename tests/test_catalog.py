"""Every registered query against its checking SQL on the given tables."""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences

from quillspark.plans.catalog import QUERIES as OWN

QUERIES = {name: fn for name, fn in contract.queries().items() if name in OWN}
ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name in OWN}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert all(not t.startswith(("array", "map", "struct")) for _, t in df.dtypes)
    assert differences(df, con, ORACLES[name]) == ""


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert os.path.isdir("/root/testdata/sf0.001")
    assert contract.entry(spark).count() > 0
