"""Plans: what reaches the scan, and what must not be in any plan."""

import os

import pytest

from palimpsest.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: These run jobs while they are built.
EAGER = {"follow_refs_bfs", "provenance_reachability", "lineage_fixpoint"}


def plan(spark, name):
    return catalog.queries()[name](spark, DATA)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - EAGER))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(spark, name)


def test_filters_reach_the_scan(spark):
    text = plan(spark, "filter_patterns_and_ranges")
    assert "GreaterThanOrEqual(p_size,10)" in text and "LessThanOrEqual(p_size,20)" in text


@pytest.mark.parametrize(("name", "absent"), [("census_semi_join", "l_comment"), ("census_semi_join", "l_quantity"), ("status_partition", "doc_id"), ("harmonisation", "n_chars"), ("blame_last_writer", "l_extendedprice")])
def test_unused_columns_are_not_read(spark, name, absent):
    schemas = [line for line in plan(spark, name).splitlines() if line.startswith("ReadSchema")]
    assert schemas and all(absent not in s for s in schemas)


@pytest.mark.parametrize("name", ["pit_two_rail", "as_of_both_sides", "blame_last_writer"])
def test_one_shuffle(spark, name):
    assert plan(spark, name).count("\nExchange") + plan(spark, name).count(") Exchange") <= 2
    assert "Window" not in plan(spark, name)
