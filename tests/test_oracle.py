"""Every registered query against its SQL counterpart, at the smallest scale."""

import os

import pytest
from oracle_check import connect, difference

from eventbook.plans.catalog import QUERIES
from eventbook.plans.oracle import ORACLES

FOLDER = os.environ.get("EVENTBOOK_TEST_DIR", "/root/testdata/sf0.001")
LOOP_TESTED: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) - set(ORACLES) == LOOP_TESTED
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None
