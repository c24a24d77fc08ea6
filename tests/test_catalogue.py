"""Every catalogue query against its SQL on the smallest tables, and the plans they make."""

import pytest

import oracle
from emberscan.plans import registry

registry.load()

# With one thousand events these find nothing to compare; they do at the next scale.
MAY_BE_EMPTY = {"network_components"}


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, folder, con, name):
    problems = oracle.compare(registry.QUERIES[name](spark, folder), con, registry.ORACLES[name])
    assert [p for p in problems if p != "no rows to compare"] == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    assert df.columns and df.count() >= 0


RELATIONAL = ("neighbour_pairs", "cross_pairs", "interval_pairs", "overlapping_extents", "nearest_coincidence", "interval_candidates",
              "points_inside_extents", "detector_edges", "tile_edges", "tile_coherence", "match_injections", "false_alarms", "scale_maximum")


@pytest.mark.parametrize("name", RELATIONAL)
def test_range_joins_are_never_cartesian_and_stay_in_the_jvm(spark, folder, name):
    plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_entry_points_agree():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_only_needed_columns_are_read(spark, folder):
    plan = registry.QUERIES["neighbour_pairs"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema:")[1].split("\n")[0]
