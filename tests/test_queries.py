"""Core queries against their SQL on the smallest tables."""

import os

import pytest

import oracle_check
from scriptoria.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle_check.duck(DATA)


#: No SQL: held against golden spans or brute force in ``test_operators``.
TESTED_OTHERWISE = {"win7_groups", "win8_chunks", "str19_fuzzy_targets"}


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_matches_sql(spark, con, name):
    said = oracle_check.compare(spark, con, name, DATA)
    assert said.startswith("rows-only" if name in TESTED_OTHERWISE else "ok"), said
