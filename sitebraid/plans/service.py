"""Queries over services: descriptions, payloads, files, completed requests and statuses, each with its SQL."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import srs, text
from ..operators import context, diagnostics, loading, raster
from ..sources import payloads, tiff
from .derived import LAT, LON, boxes, boxes_sql, d, spread, table
from .spatial import _mm

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _pick(k: Column, *values) -> Column:
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))


@query("""SELECT n_nationkey, 'dem__'||n_nationkey AS coverage_id, CASE WHEN n_nationkey%2=0 THEN 'EPSG:25832' ELSE '' END AS srs, n_nationkey*10 AS min_x, n_nationkey*10+7 AS max_x, CASE WHEN n_nationkey%2=0 THEN 'E' ELSE 'x' END AS axis_x, CASE WHEN n_nationkey%2=0 THEN 'N' ELSE 'y' END AS axis_y,
 CASE WHEN n_nationkey%3=0 THEN n_nationkey*10 ELSE 3 END AS origin_x, CASE WHEN n_nationkey%3=0 THEN 9 ELSE 4 END AS origin_y, CASE WHEN n_nationkey%5=0 THEN 1000 ELSE 500 END AS step_x, CASE WHEN n_nationkey%5=0 THEN -1000 ELSE -250 END AS step_y, CASE WHEN n_nationkey%4=0 THEN -9999 END AS nodata FROM nation""")
def coverage_descriptions(spark, sf_dir):
    k = F.col("n_nationkey")
    x = _text("<wcs:CoverageDescriptions xmlns:wcs='w' xmlns:gml='g'><wcs:CoverageDescription><gml:boundedBy><gml:Envelope", F.when(k % 2 == 0, " srsName='EPSG:25832' axisLabels=' E  N h '").otherwise(""), "><gml:lowerCorner>", k * 10, " 2</gml:lowerCorner><gml:upperCorner> ", k * 10 + 7, "\n9 </gml:upperCorner></gml:Envelope></gml:boundedBy><wcs:CoverageId> dem__", k, " </wcs:CoverageId>", F.when(k % 3 != 0, "<gml:origin><gml:Point><gml:pos>3 4</gml:pos></gml:Point></gml:origin>").otherwise(""), F.when(k % 5 != 0, "<gml:offsetVector>0.5 0</gml:offsetVector><gml:offsetVector>0 -0.25</gml:offsetVector>").otherwise(""), F.when(k % 4 == 0, "<nilValue>-9999</nilValue>").otherwise(""), "</wcs:CoverageDescription></wcs:CoverageDescriptions>")
    c = table(spark, sf_dir, "nation").select("n_nationkey", payloads.coverage_description(x).alias("c"))
    whole = lambda name: srs.whole(F.col(f"c.{name}"), 1.0)
    return c.select("n_nationkey", "c.coverage_id", "c.srs", whole("box.min_x").alias("min_x"), whole("box.max_x").alias("max_x"), "c.axis_x", "c.axis_y", whole("origin.x").alias("origin_x"), whole("origin.y").alias("origin_y"), srs.whole(F.col("c.offset_x.x")).alias("step_x"), srs.whole(F.col("c.offset_y.y")).alias("step_y"), whole("nodata").alias("nodata"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey%2=0 THEN 'http://own' WHEN n_nationkey%3=0 THEN 'http://offered' END AS endpoint, CASE WHEN n_nationkey%2=1 AND n_nationkey%5<>0 THEN '1.1.0' ELSE '2.0.0' END AS version FROM nation""")
def request_completion(spark, sf_dir):
    k = F.col("n_nationkey")
    c = loading.completed(F.when(k % 2 == 0, "http://own"), F.lit("2.0.0"), F.when(k % 3 == 0, "http://offered").otherwise(" "), F.when(k % 5 != 0, "1.1.0"))
    return table(spark, sf_dir, "nation").select("n_nationkey", c.alias("c")).select("n_nationkey", "c.endpoint", "c.version")


@query("""SELECT n_nationkey, CASE n_nationkey%5 WHEN 0 THEN '2.0.0 -,2.0.0 application/gml+xml; version=3.2,1.1.0 text/xml; subtype=gml/3.1.1' WHEN 1 THEN '2.0.0 GeoJSON,2.0.0 application/gml+xml; version=3.2,1.1.0 text/xml; subtype=gml/3.1.1'
 WHEN 2 THEN '1.1.0 TEXT/XML; subtype=gml/3.1.1' WHEN 3 THEN '2.0.0 text/csv' ELSE '1.0.0 application/json,2.0.0 application/gml+xml; version=3.2,1.1.0 text/xml; subtype=gml/3.1.1' END AS formats FROM nation""")
def request_formats(spark, sf_dir):
    k = F.col("n_nationkey")
    tries = loading.formats_to_try(_pick(k, "2.0.0", "2.0.0", "1.1.0", "2.0.0", "1.0.0"), _pick(k, F.lit(None).cast("string"), "GeoJSON", "TEXT/XML; subtype=gml/3.1.1", "text/csv", "application/json"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(tries, lambda x: F.concat_ws(" ", x["version"], F.coalesce(x["format"], F.lit("-")))), ",").alias("formats"))


@query(f"""SELECT n_nationkey, CASE n_nationkey%4 WHEN 0 THEN 'EPSG:25832' WHEN 1 THEN 'EPSG:4326' WHEN 2 THEN 'EPSG:25832' ELSE 'EPSG:3857' END AS srs, CASE n_nationkey%4 WHEN 0 THEN {_mm('(min_x+1)', '1e7')} WHEN 1 THEN {_mm('min_x', '1e7')} WHEN 2 THEN {_mm('(min_x+1)', '1e7')} END AS min_x7, n_nationkey%4=3 AS failed FROM {boxes_sql('nation', 'n_nationkey', 'n_nationkey')}""")
def request_system(spark, sf_dir):
    k = F.col("n_nationkey")
    n = boxes(table(spark, sf_dir, "nation"), "n_nationkey")
    moved = F.struct((F.col("box.min_x") + d(1.0)).alias("min_x"), F.col("box.min_y"), F.col("box.max_x"), F.col("box.max_y"))
    r = loading.in_required_system(_pick(k, F.lit(None).cast("string"), "EPSG:4326", " ", "EPSG:3857"), F.create_map(F.lit("EPSG:4326"), F.col("box")), F.lit("EPSG:25832"), moved, F.col("box"))
    return n.select("n_nationkey", r.alias("r")).select("n_nationkey", "r.srs", srs.whole(F.col("r.box.min_x"), 1e7).alias("min_x7"), F.col("r.error").isNotNull().alias("failed"))


@query("""SELECT n_nationkey, n_nationkey%4=0 AS is_name, n_nationkey%2=0 OR n_nationkey%3=0 AS wanted, CASE n_nationkey%4 WHEN 1 THEN 'maps.example' WHEN 2 THEN 'a.b' END AS host, CASE WHEN n_nationkey%4=0 THEN sha256('u'||n_nationkey)||'.tif' ELSE sha256('u'||n_nationkey)||'.png' END AS file FROM nation""")
def load_inputs(spark, sf_dir):
    k = F.col("n_nationkey")
    layer = _pick(k, "dop20_rgb", "https://maps.example/x", "http://a.b:81/ows?service=wms", "x?request=GetCapabilities")
    wanted = loading.any_wanted({"roads": k % 2 == 0, "water": F.when(k % 3 == 0, True)})
    return table(spark, sf_dir, "nation").select("n_nationkey", loading.is_layer_name(layer).alias("is_name"), wanted.alias("wanted"), text.host_label(layer).alias("host"), text.cache_file(_text("u", k), F.when(k % 4 == 0, "image/tiff").otherwise("image/png")).alias("file"))


@query("""SELECT e.user_id%7 AS key, e.event_type AS category, count(*) AS n FROM events e WHERE (e.user_id%7 = 1 AND e.event_type='view') OR (e.user_id%7 = 3 AND e.event_type='click') GROUP BY ALL""")
def cached_categories(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("key"), F.col("event_type").alias("category"))
    failed = spark.createDataFrame([(1, "view"), (1, "view"), (3, "click"), (4, "nothing")], "key long, category string")
    return loading.from_cache(failed, e).groupBy("key", "category").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey%4=0 THEN 'warning' WHEN n_nationkey%2=1 THEN 'remark' ELSE 'ok' END AS buildings, CASE WHEN n_nationkey%4=0 THEN 'No buildings in the study area.' ELSE CASE WHEN n_nationkey%2=1 THEN 'Using cached ' ELSE 'Loaded ' END||(n_nationkey%4)||CASE WHEN n_nationkey%4=1 THEN ' building' ELSE ' buildings' END||CASE WHEN n_nationkey%3=0 THEN ' with absolute elevation.' ELSE ' on the shared elevation baseline.' END END AS message,
 CASE WHEN n_nationkey%5=0 OR n_nationkey%7=0 THEN 'remark' ELSE 'ok' END AS raster, 'ok' AS terrain, CASE WHEN n_nationkey>8 AND n_nationkey%2=0 THEN 'Loading '||n_nationkey||' layers at once.' END AS layers FROM nation""")
def load_statuses(spark, sf_dir):
    k = F.col("n_nationkey")
    said = lambda kind: diagnostics.load_status(kind, k % 4, k % 2 == 1, k % 3 == 0, k % 5 == 0, k % 7 == 0)
    return table(spark, sf_dir, "nation").select("n_nationkey", said("buildings")["level"].alias("buildings"), said("buildings")["message"].alias("message"), said("raster")["level"].alias("raster"), said("terrain")["level"].alias("terrain"), diagnostics.layer_count_remark(k, k % 2 == 0).alias("layers"))


@query("""SELECT o_orderkey, CASE o_orderkey%6 WHEN 0 THEN 'geojson' WHEN 1 THEN 'geojson' WHEN 2 THEN 'xml' ELSE 'unsupported' END AS kind, CASE o_orderkey%6 WHEN 0 THEN NULL WHEN 1 THEN o_orderkey WHEN 4 THEN 12 END AS whole FROM orders""")
def payload_kinds(spark, sf_dir):
    k = F.col("o_orderkey")
    t = _pick(k, ' \n{"a":1}', "[1]", "\t<x/>", "nothing", "", "0")
    n = _pick(k, "0", _text(" ", k, " "), "-4", "x", "12", "1.5")
    return table(spark, sf_dir, "orders").select("o_orderkey", payloads.kind(t).alias("kind"), text.positive_int(n).cast("long").alias("whole"))


_X, _Y = "c_custkey", "c_custkey+1"


@query("""SELECT c_custkey, CASE c_custkey%7 WHEN 0 THEN 'Point' WHEN 1 THEN 'MultiPoint' WHEN 2 THEN 'LineString' WHEN 3 THEN 'MultiLineString' WHEN 4 THEN 'Polygon' WHEN 5 THEN 'MultiPolygon' ELSE 'Null' END AS type, CASE c_custkey%7 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS points, CASE c_custkey%7 WHEN 2 THEN '2' WHEN 3 THEN '2,1' ELSE '' END AS lines, CASE c_custkey%7 WHEN 4 THEN '4' WHEN 5 THEN '4,3' ELSE '' END AS rings,
 CASE WHEN c_custkey%7 IN (0,1,2,3,4,5) THEN c_custkey END AS first_x, 'raw' AS a, CAST(c_custkey AS VARCHAR) AS b, 'true' AS c, NULL AS d, '{"e":1}' AS nested FROM customer""")
def geojson_geometries(spark, sf_dir):
    k = F.col("c_custkey")
    x = k.cast("string")
    p = lambda dx, dy: _text("[", k + dx, ",", k + dy, "]")
    ring = lambda *ps: _text("[", F.concat_ws(",", *(p(a, b) for a, b in ps)), "]")
    square, hole, corner = ring((0, 0), (9, 0), (9, 9), (0, 0)), ring((1, 1), (2, 1), (1, 1)), ring((0, 0), (1, 0), (0, 0))
    coordinates = F.when(k % 7 == 0, p(0, 1)).when(k % 7 == 1, _text("[", p(0, 1), ",[5],", p(2, 3), "]")).when(k % 7 == 2, ring((0, 1), (2, 3))).when(k % 7 == 3, _text("[", ring((0, 1), (2, 3)), ",", ring((4, 5)), "]")).when(k % 7 == 4, _text("[", square, ",", hole, "]")).otherwise(_text("[[", square, ",", hole, "],[],[", corner, "]]"))
    kind = _pick(k, "Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "")
    shape = F.when(k % 7 == 6, F.lit("null")).otherwise(_text('{"type":"', kind, '","coordinates":', coordinates, "}"))
    payload = _text('{"type":"FeatureCollection","features":[{"type":"Feature","id":"', x, '","geometry":', shape, ',"properties":{"a":"raw","b":', x, ',"c":true,"d":null,"nested":{"e":1}}}]}')
    read = payloads.geojson(table(spark, sf_dir, "customer").select(k.alias("layer"), payload.alias("payload")))
    sizes = lambda c: F.array_join(F.transform(F.col(f"geometry.{c}"), lambda r: F.size(r).cast("string")), ",")
    first = F.coalesce(F.get("geometry.points", F.lit(0)), F.get(F.get("geometry.line_strings", F.lit(0)), F.lit(0)), F.get(F.get("geometry.outer_rings", F.lit(0)), F.lit(0)))["x"]
    value = lambda name: F.element_at("attributes", F.lit(name)).alias(name)
    return read.select(F.col("source_layer").alias("c_custkey"), F.col("geometry.type").alias("type"), F.size("geometry.points").alias("points"), sizes("line_strings").alias("lines"), sizes("outer_rings").alias("rings"), first.cast("long").alias("first_x"), *map(value, ("a", "b", "c", "d", "nested")))


@query("""SELECT c_custkey, seq, CASE seq WHEN 0 THEN 'f'||c_custkey END AS id, (['Polygon','LineString','MultiPoint','Null'])[seq+1] AS type, (['ring','line','point','none'])[seq+1] AS role, part, CASE seq WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n, CASE seq WHEN 0 THEN CASE WHEN c_custkey%2=0 THEN c_custkey ELSE 5000000+c_custkey END WHEN 1 THEN c_custkey+1 WHEN 2 THEN c_custkey+part END AS x, CASE WHEN seq=0 THEN 'n '||c_custkey END AS name
 FROM customer, (SELECT * FROM (VALUES (0,0),(1,0),(2,0),(2,1),(3,0)) t(seq, part))""")
def gml_features(spark, sf_dir):
    k = F.col("c_custkey")
    north = lambda dx, dy: _text(k + dx + 5_000_000, " ", k + dy)  # noqa: E731  a northing first is turned in EPSG systems only
    ring = F.concat_ws(" ", north(0, 0), north(0, 9), north(9, 9), north(0, 0))
    payload = _text("<c xmlns='w' xmlns:gml='g'", F.when(k % 2 == 0, " srsName='urn:ogc:def:crs:EPSG::25832'").otherwise(""), "><member><a gml:id='f", k, "'><name> n ", k, " </name><geom><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>", ring, "</gml:posList></gml:LinearRing></gml:exterior><gml:interior><gml:LinearRing><gml:posList>1 1 2 2 3 3 1 1</gml:posList></gml:LinearRing></gml:interior></gml:Polygon></geom></a></member>"
        "<gml:featureMember><a><gml:Curve><gml:segments><gml:LineStringSegment><gml:posList srsDimension='3'>", k + 1, " 2 7 ", k + 2, " 3 7</gml:posList></gml:LineStringSegment></gml:segments></gml:Curve></a></gml:featureMember><member><a><gml:MultiPoint><gml:pointMember><gml:Point><gml:pos>", k, " 5</gml:pos></gml:Point></gml:pointMember><gml:pointMember><gml:Point><gml:coordinates>", k + 1, ",6</gml:coordinates></gml:Point></gml:pointMember></gml:MultiPoint></a></member><member><a><x>y</x></a></member></c>")  # fmt: skip
    read = payloads.gml(spread(table(spark, sf_dir, "customer").select("c_custkey")).select(k.cast("string").alias("layer"), payload.alias("payload")))
    return read.select(F.col("source_layer").cast("long").alias("c_custkey"), "seq", "id", "type", "role", "part", F.size("points").alias("n"), F.get("points", F.lit(0))["x"].cast("long").alias("x"), F.element_at("attributes", F.lit("name")).alias("name"))


@query("""SELECT c_custkey, surface, ring, ring=0 AS outer_ring, CASE WHEN ring=0 THEN 5 ELSE 4 END AS n, CASE WHEN ring=0 THEN c_custkey+surface*100 ELSE 1 END AS z, 'b'||c_custkey AS id, 'L'||c_custkey AS local_id, CAST(c_custkey%50 AS VARCHAR) AS height FROM customer, (SELECT * FROM (VALUES (0,0),(0,1),(1,0)) t(surface, ring))""")
def lod2_surfaces(spark, sf_dir):
    k = F.col("c_custkey")
    face = lambda z, hole: _text("<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>", F.concat_ws(" ", *(_text(a, " ", b, " ", z) for a, b in (("0", "0"), ("9", "0"), ("9", "9"), ("0", "9"), ("0", "0")))), "</gml:posList></gml:LinearRing></gml:exterior>", hole, "</gml:Polygon>")
    hole = "<gml:interior><gml:LinearRing><gml:posList>1 1 1 2 1 1 2 2 1 1 1 1</gml:posList></gml:LinearRing></gml:interior><gml:interior><gml:LinearRing><gml:posList>1 1 1 2 1 1</gml:posList></gml:LinearRing></gml:interior>"
    payload = _text("<c xmlns='w' xmlns:gml='g'><member><Building gml:id='b", k, "' srsName='EPSG:7423'><localId>L", k, "</localId><HeightAboveGround><value>", k % 50, "</value></HeightAboveGround>", face(k, hole), face(k + 100, ""), "<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 0 1 1 1</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></Building></member><member><Building gml:id='empty'/></member></c>")
    read = payloads.lod2(spread(table(spark, sf_dir, "customer").select("c_custkey")).select(k.cast("string").alias("layer"), payload.alias("payload")))
    fact = lambda name: F.element_at("attributes", F.lit(name))
    return read.select(F.col("source_layer").cast("long").alias("c_custkey"), "surface", "ring", F.col("outer").alias("outer_ring"), F.size("points").alias("n"), F.get("points", F.lit(0))["z"].cast("long").alias("z"), "id", fact("LocalId").alias("local_id"), fact("HeightAboveGround").alias("height"))


@query("""SELECT n_nationkey, (['wfs','wms','wms','wcs'])[seq+1] AS service, (['t'||n_nationkey,NULL,'inner','c'||n_nationkey])[seq+1] AS name, (['Title','Root','inner','c'||n_nationkey])[seq+1] AS title, (['EPSG:25832,EPSG:4326','EPSG:3857','EPSG:25833',''])[seq+1] AS srs, CASE seq WHEN 2 THEN '1' END AS parent_id, CASE seq WHEN 0 THEN n_nationkey WHEN 2 THEN 7 END AS min_x, '2.0.0' AS version, 'http://h'||n_nationkey||'/get' AS get_url FROM nation, (SELECT unnest(range(0,4))::INTEGER AS seq)""")
def service_descriptions(spark, sf_dir):
    k = F.col("n_nationkey")
    payload = _text("<Caps xmlns='w' xmlns:xlink='x' version='2.0.0'><OperationsMetadata><Operation name='GetFeature'><DCP><HTTP><Get xlink:href='http://h", k, "/get'/></HTTP></DCP></Operation></OperationsMetadata><FeatureTypeList><FeatureType><Name> t", k, " </Name><Title>Title</Title><DefaultCRS>EPSG:25832</DefaultCRS><OtherCRS>EPSG:4326</OtherCRS><OtherCRS>EPSG:25832</OtherCRS><WGS84BoundingBox><LowerCorner>", k, " 50</LowerCorner><UpperCorner>", k + 1, " 51</UpperCorner></WGS84BoundingBox></FeatureType></FeatureTypeList>"
        "<Layer><Title>Root</Title><SRS>EPSG:3857</SRS><Layer><Name>inner</Name><Title> </Title><CRS>EPSG:25833</CRS><LatLonBoundingBox minx='7' miny='50' maxx='8' maxy='51'/></Layer></Layer><CoverageSummary><CoverageId>c", k, "</CoverageId></CoverageSummary><CoverageSummary><Abstract>no id</Abstract></CoverageSummary></Caps>")  # fmt: skip
    read = payloads.capabilities(table(spark, sf_dir, "nation").select(payload.alias("payload")))
    return read.select(F.regexp_extract("get_url", "h([0-9]+)/", 1).cast("long").alias("n_nationkey"), "service", "name", "title", F.array_join("srs", ",").alias("srs"), "parent_id", F.col("box.min_x").cast("long").alias("min_x"), "version", "get_url")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey%3=0")
def service_errors_give_no_rows(spark, sf_dir):
    k = F.col("n_nationkey")
    payload = F.when(k % 3 == 0, _text("<c><member><a id='", k, "'/></member></c>")).when(k % 3 == 1, "<ows:ExceptionReport xmlns:ows='o'><ows:Exception><ows:ExceptionText>no</ows:ExceptionText></ows:Exception></ows:ExceptionReport>").otherwise("not xml")
    read = payloads.gml(table(spark, sf_dir, "nation").select(F.lit("l").alias("layer"), payload.alias("payload")), mode="permissive")
    return read.select(F.col("id").cast("long").alias("n_nationkey"))


def _tiff_start() -> bytes:
    """A file of 3 by 2 signed 16-bit cells up to its data: scale 0.5, tie point at (100, 200), system 25832, nodata -9999."""
    scale, tie, keys, nodata = struct.pack("<3d", 0.5, 0.5, 0.0), struct.pack("<6d", 0, 0, 0, 100, 200, 0), struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, 25832), b"-9999\0"
    entries = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, None), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, 1, 12), (339, 3, 1, 2), (33550, 12, 3, scale), (33922, 12, 6, tie), (34735, 3, 8, keys), (42113, 2, len(nodata), nodata)]
    at = 8 + 2 + 12 * len(entries) + 4
    extra, out = b"", struct.pack("<2sHIH", b"II", 42, 8, len(entries))
    total = at + sum(len(v) for *_, v in entries if isinstance(v, bytes))
    for tag, kind, count, value in entries:
        if isinstance(value, bytes):
            out += struct.pack("<HHII", tag, kind, count, at + len(extra))
            extra += value
        else:
            out += struct.pack("<HHII", tag, kind, count, total if value is None else value)
    return out + b"\0" * 4 + extra


def _tiffs(spark, sf_dir):
    """A raster a supplier whose cell i holds k % 1000 + i, but the last nodata."""
    k = F.col("s_suppkey") % 1000
    low = lambda v: F.lpad(F.hex(v % 256), 2, "0")
    cell = lambda v: F.concat(low(v), low(F.floor(v / 256)))
    content = F.unhex(F.concat(F.lit(_tiff_start().hex()), *(cell(k + i) for i in range(5)), F.lit(struct.pack("<h", -9999).hex())))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), content.alias("content")).withColumn("length", F.length("content").cast("long"))


@query("SELECT s_suppkey, 3 AS width, 2 AS height, 25832 AS epsg, -9999 AS nodata, 100000 AS x0, 199000 AS y0, 101500 AS x1 FROM supplier")
def tiff_headers(spark, sf_dir):
    h = tiff.headers(_tiffs(spark, sf_dir))
    b = raster.box_from_tiepoint(F.col("width"), F.col("height"), F.col("pixel_scale"), F.col("tiepoint"))
    return h.select(F.col("path").cast("long").alias("s_suppkey"), "width", "height", "epsg", F.col("nodata").cast("int").alias("nodata"), srs.whole(b["min_x"]).alias("x0"), srs.whole(b["min_y"]).alias("y0"), srs.whole(b["max_x"]).alias("x1"))


@query('SELECT s_suppkey, i//3 AS "row", i%3 AS col, CASE WHEN i=5 THEN -9999 ELSE s_suppkey%1000+i END AS z FROM supplier, (SELECT unnest(range(0,6))::INTEGER AS i)')
def tiff_cells(spark, sf_dir):
    return tiff.cells(_tiffs(spark, sf_dir)).select(F.col("path").cast("long").alias("s_suppkey"), "row", "col", F.col("z").cast("int").alias("z"))


@query(f"""SELECT n_nationkey, CASE WHEN n_nationkey%2=0 THEN 0 ELSE CAST(n_nationkey*1000 AS BIGINT) END AS placed_x, (n_nationkey+2)*(n_nationkey+3) AS area, CASE WHEN n_nationkey < 10 THEN 10 ELSE n_nationkey END AS clamp_x0, CASE WHEN n_nationkey < 8 THEN 2*n_nationkey+2 WHEN n_nationkey < 20 THEN least(2*n_nationkey+2, 30) ELSE least(2*n_nationkey+2, 30) END AS clamp_x1 FROM nation""".replace("CASE WHEN n_nationkey < 10 THEN 10 ELSE n_nationkey END AS clamp_x0", "CASE WHEN 2*n_nationkey+2 > 10 AND n_nationkey < 30 THEN greatest(n_nationkey, 10) ELSE n_nationkey END AS clamp_x0").replace("CASE WHEN n_nationkey < 8 THEN 2*n_nationkey+2 WHEN n_nationkey < 20 THEN least(2*n_nationkey+2, 30) ELSE least(2*n_nationkey+2, 30) END AS clamp_x1", "CASE WHEN 2*n_nationkey+2 > 10 AND n_nationkey < 30 THEN least(2*n_nationkey+2, 30) ELSE 2*n_nationkey+2 END AS clamp_x1"))
def box_arithmetic(spark, sf_dir):
    k = F.col("n_nationkey").cast("double")
    box = lambda x0, y0, x1, y1: F.struct(x0.alias("min_x"), y0.alias("min_y"), x1.alias("max_x"), y1.alias("max_y"))
    own = box(k, d(0.0), k * 2 + 2, k + 3)
    start = context.origin(box(d(0.0), d(0.0), d(1.0), d(1.0)), F.col("n_nationkey") % 2 == 1)
    moved = context.placed(own, F.when(F.col("n_nationkey") % 2 == 0, F.struct(k.alias("x"), d(0.0).alias("y"))).otherwise(start))
    inside = raster.clamped(own, box(d(10.0), d(-5.0), d(30.0), d(99.0)))
    return table(spark, sf_dir, "nation").select("n_nationkey", srs.whole(moved["min_x"]).alias("placed_x"), g.box_area(own).cast("long").alias("area"), inside["min_x"].cast("long").alias("clamp_x0"), inside["max_x"].cast("long").alias("clamp_x1"))
