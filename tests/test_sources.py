"""Readers of payloads and files on small made-up inputs."""

import math
import struct
import zlib

import numpy as np
import pytest

GML = """<c:FeatureCollection xmlns:c="c" xmlns:gml="g" srsName="urn:ogc:def:crs:EPSG::25832">
<c:member><a:Plan xmlns:a="a" gml:id="p.1"><a:name>One</a:name><a:shape><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>5600000 400000 5600000 400010 5600010 400010 5600000 400000</gml:posList></gml:LinearRing></gml:exterior><gml:interior><gml:LinearRing><gml:posList>1 1 2 2 3 3 1 1</gml:posList></gml:LinearRing></gml:interior></gml:Polygon></a:shape></a:Plan></c:member>
<gml:featureMember><b:Path xmlns:b="b"><b:way><gml:MultiCurve><gml:curveMember><gml:LineString srsDimension="3"><gml:posList>1 2 3 4 5 6 x 8 9</gml:posList></gml:LineString></gml:curveMember><gml:curveMember><gml:LineString><gml:pos>7 8</gml:pos><gml:pos>9 10</gml:pos></gml:LineString></gml:curveMember></gml:MultiCurve></b:way></b:Path></gml:featureMember>
<c:member><a:Spot xmlns:a="a"><a:at><gml:Point><gml:coordinates>3,4</gml:coordinates></gml:Point></a:at></a:Spot></c:member></c:FeatureCollection>"""
LOD = """<x:c xmlns:x="x" xmlns:gml="g"><bu:Building xmlns:bu="b" gml:id="B1"><bu:identifier>ID-1</bu:identifier><bu:HeightAboveGround><bu:value>12.5</bu:value></bu:HeightAboveGround><bu:geometry3DLoD2 srsName="EPSG:7423"><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 0 0 1 0 1 1 0 0 0 0</gml:posList></gml:LinearRing></gml:exterior><gml:interior><gml:LinearRing><gml:posList>0 0 0</gml:posList></gml:LinearRing></gml:interior></gml:Polygon></bu:geometry3DLoD2></bu:Building><bu:Building xmlns:bu="b"/></x:c>"""
WMS = """<W version="1.3.0" xmlns:xlink="l"><GetMap><Get><OnlineResource xlink:href="http://m?"/></Get></GetMap><Layer><Title>all</Title><CRS>EPSG:4326</CRS><Layer><Name>a</Name><CRS>EPSG:25832 EPSG:3857</CRS><EX_GeographicBoundingBox><westBoundLongitude>8</westBoundLongitude><southBoundLatitude>50</southBoundLatitude><eastBoundLongitude>9</eastBoundLongitude><northBoundLatitude>51</northBoundLatitude></EX_GeographicBoundingBox></Layer></Layer></W>"""
JSON = '{"features":[{"id":7,"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]],[[0.1,0.1],[0.2,0.1],[0.2,0.2],[0.1,0.1]]]},"properties":{"Name":"a","NAME":"b","deep":{"k":1}}},{"geometry":null,"properties":null},{"geometry":{"type":"MultiPoint","coordinates":[[1,2],[3]]}},{"geometry":{"type":"LineString"}},{"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[0,1],[0,0]]],[[[5,5],[6,5],[5,6],[5,5]]]]}},{"geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,1]]]}},{"geometry":{"type":"Point","coordinates":[4]}}]}'


def frame(spark, *texts):
    return spark.createDataFrame([("l", t) for t in texts], "layer string, payload string")


def test_geojson(spark):
    from sitebraid.sources.payloads import geojson

    rows = {r["seq"]: r for r in geojson(frame(spark, JSON)).collect()}
    assert len(rows) == 7 and rows[0]["id"] == "7" and len(rows[0]["geometry"]["outer_rings"]) == 1
    assert rows[0]["attributes"]["Name"] == "b" and "NAME" not in rows[0]["attributes"]
    assert rows[1]["geometry"]["type"] == "Null" and rows[1]["attributes"] == {}
    assert [(p["x"], p["y"]) for p in rows[2]["geometry"]["points"]] == [(1, 2)]
    assert rows[3]["geometry"]["type"] == "LineString" and rows[3]["geometry"]["line_strings"] == []
    assert len(rows[4]["geometry"]["outer_rings"]) == 2 and len(rows[5]["geometry"]["line_strings"]) == 1
    assert [(p["x"], p["y"]) for p in rows[6]["geometry"]["points"]] == [(0, 0)]
    assert [r[0] for r in frame(spark, " {", "\n<a/>", "x").select(kind_of()).collect()] == ["geojson", "xml", "unsupported"]
    with pytest.raises(Exception, match="Unsupported geometry"):
        geojson(frame(spark, '{"features":[{"geometry":{"type":"Blob","coordinates":[]}}]}')).collect()


def kind_of():
    from pyspark.sql import functions as F

    from sitebraid.sources.payloads import kind

    return kind(F.col("payload"))


def test_gml(spark):
    from sitebraid.sources.payloads import gml

    rows = gml(frame(spark, GML)).collect()
    polygon = [r for r in rows if r["id"] == "p.1"]
    assert len(polygon) == 1 and polygon[0]["role"] == "ring" and polygon[0]["points"][0]["x"] == 400000 and polygon[0]["attributes"]["name"] == "One"
    lines = [r for r in rows if r["type"] == "MultiLineString"]
    assert [[(p["x"], p["y"]) for p in r["points"]] for r in lines] == [[(1, 2), (4, 5)], [(7, 8), (9, 10)]]
    assert [(p["x"], p["y"]) for r in rows if r["type"] == "Point" for p in r["points"]] == [(3, 4)]
    with pytest.raises(Exception, match="layer is closed"):
        gml(frame(spark, "<ExceptionReport><Exception><ExceptionText>layer is closed</ExceptionText></Exception></ExceptionReport>")).collect()
    assert gml(frame(spark, "<broken"), mode="permissive").collect() == []


def test_lod2(spark):
    from sitebraid.sources.payloads import lod2

    rows = lod2(frame(spark, LOD)).collect()
    assert len(rows) == 1 and rows[0]["outer"] and len(rows[0]["points"]) == 4 and rows[0]["attributes"] == {"Identifier": "ID-1", "HeightAboveGround": "12.5"}


def test_capabilities(spark):
    from sitebraid.operators.catalog import inherited
    from sitebraid.sources.payloads import capabilities

    rows = capabilities(frame(spark, WMS))
    got = rows.orderBy("seq").collect()
    assert [r["name"] for r in got] == [None, "a"] and got[1]["box"]["max_y"] == 51 and got[1]["get_url"] == "http://m?" and got[1]["version"] == "1.3.0"
    tree = {r["name"]: r["srs_list"] for r in inherited(rows.select("node_id", "parent_id", "name", "srs")).collect()}
    assert tree["a"] == ["EPSG:4326", "EPSG:25832", "EPSG:3857"]


def tiff(z: np.ndarray, deflated: bool = False, bands: int = 1, bits: int | None = None) -> bytes:
    """A small file: one strip, elevation tags, scale, tie point, system and nodata."""
    data = z.tobytes()
    data = zlib.compress(data) if deflated else data
    form = 3 if z.dtype.kind == "f" else 2
    entries = [(256, 4, [z.shape[1]]), (257, 4, [z.shape[0]]), (258, 3, [bits or z.dtype.itemsize * 8]), (259, 3, [8 if deflated else 1]), (273, 4, [None]), (277, 3, [bands]), (279, 4, [len(data)]), (339, 3, [form]), (33550, 12, [0.5, 0.5, 0.0]), (33922, 12, [0, 0, 0, 100.0, 200.0, 0]), (34735, 3, [1, 1, 0, 1, 3072, 0, 1, 25832]), (42113, 2, b"-9999\0")]
    at = 8 + 2 + 12 * len(entries) + 4
    body, directory = b"", struct.pack("<H", len(entries))
    for tag, kind, values in entries:
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[kind]}", *(at if v is None else v for v in values))
        if tag == 273:
            raw, place = None, len(directory)
        if raw is None or len(raw) <= 4:
            directory += struct.pack("<HHI", tag, kind, len(values)) + (raw or b"").ljust(4, b"\0")
        else:
            directory += struct.pack("<HHII", tag, kind, len(values), at + len(body))
            body += raw
    start = at + len(body)
    directory = directory[: place + 8] + struct.pack("<I", start) + directory[place + 12 :]
    return b"II*\0" + struct.pack("<I", 8) + directory + b"\0\0\0\0" + body + data


def test_tiff(spark, tmp_path):
    from pyspark.sql import functions as F

    from sitebraid.operators.raster import box_from_tiepoint
    from sitebraid.sources import tiff as t

    f = np.arange(20, dtype="<f4").reshape(4, 5)
    (tmp_path / "a.tif").write_bytes(tiff(f))
    (tmp_path / "b.tif").write_bytes(tiff(f.astype("<i2"), deflated=True))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    for path, rows in {r["path"]: r for r in t.headers(files).collect()}.items():
        assert (rows["width"], rows["height"], rows["epsg"], rows["nodata"]) == (5, 4, 25832, -9999.0)
    cells = {(r["path"][-5], r["row"], r["col"]): r["z"] for r in t.cells(files).collect()}
    assert len(cells) == 40 and all(cells[n, i, j] == f[i, j] for n in "ab" for i in range(4) for j in range(5))
    box = t.headers(files).select(box_from_tiepoint(F.col("width"), F.col("height"), F.col("pixel_scale"), F.col("tiepoint")).alias("b")).first()["b"]
    assert (box["min_x"], box["min_y"], box["max_x"], box["max_y"]) == (100.0, 198.0, 102.5, 200.0)
    for bad in (tiff(f, bands=3), tiff(f.astype("u1"), bits=8), b"nothing"):
        with pytest.raises(ValueError):
            t.grid(bad)


def test_regions():
    from sitebraid.operators.topology import buffered, region

    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    tile = (-10.0, -10.0, 20.0, 20.0)
    area = lambda a, b=(), t=tile: sum(r[-1] for r in region(list(a), list(b), t))
    assert math.isclose(area([square, square + 2]), 28) and math.isclose(area([square], [square + 2]), 12)
    assert math.isclose(area([square], (), (1.0, 1.0, 3.0, 9.0)), 6)
    triangle = np.array([[0, 0], [6, 0], [0, 6]], float)
    assert math.isclose(area([triangle, square]), 18 + 2, abs_tol=1e-9)
    bent = buffered(np.array([[0, 0], [5, 0], [5, 5]], float), 2.0)
    assert math.isclose(area(bent), 20 - 1 + math.pi / 4, rel_tol=1e-3)


def test_ring_assembly_and_snapping(spark):
    from sitebraid.operators.merging import snapped
    from sitebraid.operators.surfaces import assembled

    p = lambda *c: [{"x": float(x), "y": float(y)} for x, y in c]
    rows = [(1, 0, p((0, 0), (1, 0))), (1, 1, p((1, 1), (1, 0))), (1, 2, p((0, 0), (0, 1), (1, 1))), (2, 0, p((0, 0), (1, 0), (1, 1))), (3, 0, p((0, 0), (1, 0)))]
    got = {r["relation"]: [(q["x"], q["y"]) for q in r["points"]] for r in assembled(spark.createDataFrame(rows, "relation int, seq int, points array<struct<x:double,y:double>>"), "relation", "seq").collect()}
    assert got[1][0] == got[1][-1] and len(got[1]) == 5 and got[2] == [(0, 0), (1, 0), (1, 1), (0, 0)] and 3 not in got
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.0005, 0.0, 0.0), (1, 2, 0.5, 0.0, 0.0)], "b int, i int, x double, y double, z double")
    assert [r["x"] for r in snapped(v, "b", "i", 0.001).orderBy("i").collect()] == [0.0, 0.0, 0.5]


def test_selection_stream(spark, tmp_path):
    from sitebraid.streaming.selection import changes_stream

    spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, "x"), ("a", 5, None)], "key string, seq long, selection string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, selection string").json(str(tmp_path / "in"))
    q = changes_stream(stream).writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["seq"] for r in spark.sql("SELECT seq FROM changed").collect()) == [1, 3, 4]
