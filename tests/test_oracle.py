"""A cross-section of the registered queries against DuckDB; `python tests/oracle.py` runs them all."""

import pytest

import __spark_entry__ as entry
from shootlake.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["burst_index", "catalogue_records", "settings_as_rendered", "recipe_errors", "recipe_insert", "white_balance",
         "downscale", "noise_profile", "lens_aliases", "still_upsert", "recipe_rewire", "lut_problems", "absent_luts",
         "project_violations", "region_read", "node_faults", "node_render_faults", "render_options", "latest_results", "streamed_bursts"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_query_is_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120
    # what SQL cannot say in reasonable time is held against brute force instead: tests/test_pixels.py and tests/test_tables.py
    assert set(registry.QUERIES) - set(registry.ORACLE) <= {"full_recipe_render", "collision_free_names"}
