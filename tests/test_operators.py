"""Fixed values in literals, and operators whose cases the tables don't hold."""

import pytest
from pyspark.sql import functions as F


def test_fixed_values():
    from sitebraid.functions import requests, srs
    from sitebraid.operators import catalog, loading, osm

    assert srs.RANKS == {"25832": 100, "25833": 95, "27700": 90, "3857": 70, "7844": 40, "4283": 35, "4326": 10, "7423": 5}
    assert osm.ROAD_WIDTHS["motorway"] == 18 and osm.ROAD_WIDTHS["primary"] == 14 and len(osm.ROAD_WIDTHS) == 13 and osm.OTHER_ROAD == 8
    assert osm.RAIL_WIDTHS == {"rail": 5, "light_rail": 4, "tram": 3.5, "subway": 4.5, "narrow_gauge": 3.5}
    assert catalog.IMAGERY_SCORES[0] == (("dop",), 100) and catalog.BUILDING_SCORES == ((("building",), 100), (("lod2",), 80), (("bu-core3d",), 50))
    assert requests.TILE_EDGE == {"green": 0.0025, "water": 0.0035, "buildings": 0.0045, "roads": 0.0045, "rail": 0.006}
    assert loading.LATER_FORMATS == (("2.0.0", "application/gml+xml; version=3.2"), ("1.1.0", "text/xml; subtype=gml/3.1.1"))
    assert (srs.AXIS, srs.FLATTENING) == (6378137.0, 1 / 298.257223563)


def test_rings_go_on_with_segments_that_touch_them(spark):
    from sitebraid.operators.surfaces import assembled

    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    rows = [(1, 0, p((0, 0), (4, 0), (4, 4), (0, 0))), (1, 1, p((0, 0), (-3, 0), (-3, -3)))]
    got = assembled(spark.createDataFrame(rows, "r int, o int, points array<struct<x:double,y:double>>"), "r", "o").collect()
    assert len(got) == 1 and len(got[0]["points"]) == 7  # the closed ring takes on the segment and is closed by force


def test_shells_of_a_large_building(spark, monkeypatch):
    from sitebraid.operators import surfaces

    monkeypatch.setattr(surfaces, "LARGE", 50)
    rows = [(1, i, f"e{j}") for i in range(120) for j in (i, i + 1) if i != 60] + [(2, 5, "a"), (2, 3, "a"), (2, 9, "b")]
    got = {(r["b"], r["s"]): r["shell"] for r in surfaces.components(spark.createDataFrame(rows, "b int, s int, edge string"), "b", "s").collect()}
    assert got == {**{(1, i): 0 if i < 60 else 61 for i in range(120) if i != 60}, (2, 5): 3, (2, 3): 3, (2, 9): 9}


def test_crowded_tiles_give_the_same_area(spark, monkeypatch):
    from sitebraid.operators import topology

    rows = [("g", [{"x": x, "y": y}, {"x": x + 7.0, "y": y}, {"x": x + 7.0, "y": y + 5.0}, {"x": x, "y": y + 5.0}]) for x in map(float, range(0, 90, 4)) for y in map(float, range(0, 90, 3))]
    df = spark.createDataFrame(rows, "g string, ring array<struct<x:double,y:double>>")
    want = topology.dissolved(df, ("g",), 100.0).agg(F.sum("area")).first()[0]
    monkeypatch.setattr(topology, "CROWD", 20)
    assert topology.dissolved(df, ("g",), 100.0).agg(F.sum("area")).first()[0] == pytest.approx(want) == pytest.approx(95.0 * 92.0)


def test_deep_layer_trees_and_cycles(spark):
    from sitebraid.operators.catalog import inherited

    schema = "node_id string, parent_id string, name string, srs array<string>"
    chain = [(str(i), str(i - 1) if i else None, None, [f"s{i % 3}"]) for i in range(20)]
    got = {r["node_id"]: r["srs_list"] for r in inherited(spark.createDataFrame(chain, schema)).collect()}
    assert len(got) == 20 and got["19"] == ["s0", "s1", "s2"]
    with pytest.raises(ValueError):
        inherited(spark.createDataFrame([("a", None, None, []), ("a", "b", None, []), ("b", "a", None, [])], schema))


def test_contexts_are_saved_and_restored(spark, tmp_path):
    from sitebraid.operators import context

    text = '{"resolvedSrs":"EPSG:25832","requestBoundingBox":{"minX":1.0,"minY":2.0,"maxX":3.0,"maxY":4.0},"useAbsoluteCoordinates":true}'
    context.save(spark.createDataFrame([("a", text), ("b", "{}"), ("c", None)], "name string, context string"), str(tmp_path / "contexts"))
    got = {r["name"]: r["context"] for r in context.restore(spark, str(tmp_path / "contexts")).collect()}
    assert got["a"]["requestBoundingBox"]["maxY"] == 4 and got["b"] is None and got["c"] is None


def test_errors_of_the_reading_itself_are_caught(spark):
    from sitebraid.operators.diagnostics import guarded

    empty = spark.createDataFrame([], "id long")
    good, said = guarded(lambda: spark.range(3), empty)
    assert good.count() == 3 and said.first()["level"] == "ok"
    bad, said = guarded(lambda: spark.range(3).select(F.raise_error(F.lit("the service is down")).cast("long").alias("id")), empty)
    assert bad.count() == 0 and said.first()["level"] == "error"


def test_a_coverage_without_an_envelope_fails(spark):
    from sitebraid.sources.payloads import coverage_description

    with pytest.raises(Exception, match="no envelope"):
        spark.createDataFrame([("<a/>",)], "x string").select(coverage_description(F.col("x"))).collect()


def test_closing_gives_a_rectangle_back():
    import numpy as np

    from sitebraid.operators import topology

    rings = [np.array([(x, 0.0), (x + 20, 0.0), (x + 20, 10.0), (x, 10.0)]) for x in (0.0, 100.0, 300.0)]
    area = topology.smoothed(rings, [], (-50.0, -50.0, 400.0, 60.0), closing=4.0)[:, 6].sum()
    assert area == pytest.approx(600.0, abs=1e-6)


def test_a_road_has_no_rail_width(spark):
    from sitebraid.operators import osm

    rows = [({"railway": "tram", "width": "2 m"}, 3.0), ({"railway": "rail"}, 5.0), ({"railway": "monorail"}, 4.0), ({}, 4.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "tags map<string,string>, want double")
    assert all(r[0] == r[1] for r in df.select(osm.rail_width(F.col("tags")), "want").collect())


def test_points_bound_the_edges_of_a_building(spark):
    from sitebraid.operators import surfaces

    p = lambda *xyz: [dict(zip("xyz", map(float, q), strict=True)) for q in xyz]
    rows = [(1, 0, p((0, 0, 0), (1, 0, 0), (1, 1, 0))), (1, 1, p((0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 0, 1))), (2, 0, None)]
    df = spark.createDataFrame(rows, "b int, s int, outer array<struct<x:double,y:double,z:double>>")
    bounds = dict(map(tuple, surfaces.edge_bounds(df, "b").collect()))
    edges = dict(map(tuple, surfaces.edges(df, "b", "s").groupBy("b").count().collect()))
    assert bounds == {1: 7, 2: 0} and edges == {1: 6}
