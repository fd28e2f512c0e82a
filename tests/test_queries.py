"""Every registered LiDAR query against its DuckDB equivalent; the others run and keep their properties."""

import pytest

import __spark_entry__
from echograin import registry
from tests import oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_oracle(spark, con, name):
    assert oracle.assert_equal(QUERIES[name](spark, SF), con, SQL[name]) >= (name not in ("peaks_to_points", "scene_split", "find_frame"))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_and_repeats(spark, name):
    first, second = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first == second and first


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2  # one scene and "all"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
