"""Every query with reference SQL gives the same rows; the others run."""

import pytest
from compare import compare, connect

from pressmill.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["c3_legacy_fetch", "c6_combine_pools", "c9_digests", "c15_collect_ranked", "c16_daily_run"])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
