"""Every registered query against its SQL, on the smallest tables."""

import pytest

from cellscape.plans import ORACLES, QUERIES
from check_queries import compare, connect

@pytest.fixture(scope="module")
def con(tables):
    return connect(tables)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_matches_sql(spark, tables, con, name):
    assert compare(QUERIES[name](spark, tables), con, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark, tables):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_pair_joins(spark, tables):
    """No plan falls back to comparing everything with everything."""
    for name in ("J5_held_out_maps", "J6_footprint_exclusion", "J7_intersections", "G4_tile_adjacency", "E2_fold_plan", "T5_nominal_placement"):
        plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_reads_only_needed_columns(spark, tables):
    plan = QUERIES["A7_layer_stats"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan.split("ReadSchema")[1].split("\n")[0]
