"""Every registered query against its SQL on the smallest given tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, duck
from workload.oracles import ORACLES
from workload.queries import QUERIES

FOLDER = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SLOW = {"m8_fit_ovr", "m13_report"}  # fitted weights; m8_fit_is_minimum and m13_train check them


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    verdict, rows = compare(spark, con, QUERIES[name], ORACLES[name], FOLDER)
    assert verdict == "equal" and rows > 0


def test_every_oracle_has_a_query():
    assert set(QUERIES) - set(ORACLES) == SLOW
    assert not set(ORACLES) - set(QUERIES)
    # The corpus operators join both where they are present.
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert not set(oracle_sql()) - set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["request_id", "label", "count", "percentage", "percentage_text"]
