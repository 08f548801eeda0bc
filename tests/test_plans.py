"""Shapes of plans that must hold at any scale."""

import re

import pytest
from compare import SMALL

from sitebraid.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_pairs_of_everything(spark, name):
    text = plan(registry.queries()[name](spark, SMALL))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize(("name", "columns"), [("osm_category_counts", {"event_type", "props"}), ("osm_merge_last_wins", {"event_id", "event_type", "user_id"}), ("terrain_avg_elevation", {"c_custkey", "c_nationkey"}), ("crs_to_utm32", {"c_custkey"})])
def test_only_needed_columns_are_read(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(registry.queries()[name](spark, SMALL)))
    assert read and {c.split(":")[0] for r in read for c in r.split(",")} <= columns


def test_filters_reach_the_scan(spark):
    text = plan(registry.queries()["srs_best_rank"](spark, SMALL).where("p_brand = 'Brand#11'"))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(p_brand", text)


@pytest.mark.parametrize(("name", "broadcasts"), [("terrain_bilinear_sample", 3), ("terrain_avg_elevation", 3), ("placed_elevations", 3), ("shared_plan_elevation", 3), ("terrain_meshes", 0), ("terrain_normals", 0)])
def test_cells_and_vertices_are_not_broadcast(spark, name, broadcasts):
    text = plan(registry.queries()[name](spark, SMALL))
    assert text.count("BroadcastHashJoin") == broadcasts  # of rasters' numbers, twice, and of the rasters asked for
    if broadcasts:
        assert re.search(r"SortMergeJoin \[raster_id#\w+, row#\w+, col#", text)


@pytest.mark.parametrize("name", ["green_areas", "fitted_planes", "gml_features", "lod2_surfaces", "terrain_baseline"])
def test_rows_of_one_file_are_dealt_over_tasks(spark, name):
    assert "RoundRobinPartitioning(8), REPARTITION_BY_NUM" in plan(registry.queries()[name](spark, SMALL))


def test_relations_are_not_a_frame_each(spark):
    assert "FlatMapGroupsInPandas" not in plan(registry.queries()["ring_assembly"](spark, SMALL))
