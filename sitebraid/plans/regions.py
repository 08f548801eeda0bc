"""Queries over polygon regions and over payloads written and read back, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import srs
from ..operators import topology
from ..sources import payloads
from .derived import LAT, LON, d, lon_lat, table
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


_ROAD = "(SELECT c_custkey AS k, c_nationkey%5 AS g, c_custkey*37%100*20 AS x, c_custkey*61%100*20 AS y, c_custkey%2 AS v FROM customer)"
_CELLS = f"(SELECT DISTINCT g, cx, cy FROM (SELECT g, x//2 + CASE WHEN v=0 THEN a ELSE b-2 END AS cx, y//2 + CASE WHEN v=0 THEN b-2 ELSE a END AS cy FROM {_ROAD}, (SELECT unnest(range(0,50)) AS a), (SELECT unnest(range(0,4)) AS b)))"


def _roads(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = (k * 37 % 100 * 20).cast("double"), (k * 61 % 100 * 20).cast("double")
    end = F.when(k % 2 == 0, F.struct((x + 100.0).alias("x"), y.alias("y"))).otherwise(F.struct(x.alias("x"), (y + 100.0).alias("y")))
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), (F.col("c_nationkey") % 5).alias("g"), F.array(F.struct(x.alias("x"), y.alias("y")), end).alias("line"), d(8.0).alias("width"))
    return topology.buffers(rows, "line", "width")


@query(f"SELECT k, 8000000 AS area_cm FROM {_ROAD}")
def road_buffer_area(spark, sf_dir):
    r = _roads(spark, sf_dir).select("k", F.explode("rings").alias("ring"))
    return r.groupBy("k").agg(srs.whole(F.sum(F.abs(g.twice_area(F.col("ring")))) / 2.0, 10000.0).alias("area_cm"))


@query(f"SELECT g, CAST(count(*)*4 AS BIGINT) AS area FROM {_CELLS} GROUP BY g")
def road_surfaces(spark, sf_dir):
    r = _roads(spark, sf_dir).select("g", F.explode("rings").alias("ring"))
    return topology.dissolved(r, ("g",), 500.0).groupBy("g").agg(srs.whole(F.sum("area"), 1.0).alias("area"))


#: Rectangles far from each other, of 20 + c % 7 by 10 + c % 5, pairs of them 4 apart; what closing and opening by 4 leave of each.
_STEP = math.pi / 2 / topology.QUARTER
_DISC = 2 * topology.QUARTER * 16 * math.sin(_STEP)
_BITE = topology.QUARTER * 2 / 3 * 8 * math.sin(_STEP) - 8 * math.sin(math.pi / 3)
_YARD = "(SELECT c_custkey AS k, c_nationkey%5 AS g, 20+c_custkey%7 AS w, 10+c_custkey%5 AS h, c_custkey%3=0 AS two FROM customer)"


def _yards(spark, sf_dir):
    k = F.col("c_custkey")
    x, y, w, h = ((v).cast("double") for v in (k % 1000 * 100, F.expr("c_custkey div 1000") * 100, 20 + k % 7, 10 + k % 5))
    rect = lambda a: F.array(*(F.struct((x + p).alias("x"), (y + q).alias("y")) for p, q in ((a, d(0)), (a + w, d(0)), (a + w, h), (a, h))))
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("g"), F.when(k % 3 == 0, F.array(rect(d(0)), rect(w + 4))).otherwise(F.array(rect(d(0)))).alias("rings"))
    return c.select("g", F.explode("rings").alias("ring"))


@query(f"SELECT g, CAST(round(sum(CASE WHEN two THEN 2*w*h + 4*h - 2*CAST('{_BITE!r}' AS DOUBLE) ELSE w*h END)) AS BIGINT) AS area FROM {_YARD} GROUP BY g")
def regions_closed(spark, sf_dir):
    return topology.dissolved(_yards(spark, sf_dir), ("g",), 700.0, closing=4.0).groupBy("g").agg(F.round(F.sum("area")).cast("long").alias("area"))


@query(f"SELECT g, CAST(round(sum((CASE WHEN two THEN 2 ELSE 1 END)*(w*h - 64 + CAST('{_DISC!r}' AS DOUBLE)))) AS BIGINT) AS area FROM {_YARD} GROUP BY g")
def regions_opened(spark, sf_dir):
    return topology.dissolved(_yards(spark, sf_dir).withColumn("by", d(4.0)), ("g",), 700.0, opening="by").groupBy("g").agg(F.round(F.sum("area")).cast("long").alias("area"))


#: Outer rings less holes of the roads' regions, which keep apart where they touch in a point only: cells less inner sides and more inner corners.
_RINGS = f"""(WITH c AS {_CELLS} SELECT g, sum(n) AS euler FROM (SELECT g, count(*) AS n FROM c GROUP BY g UNION ALL SELECT a.g, -count(*) FROM c a JOIN c b ON a.g=b.g AND a.cx+1=b.cx AND a.cy=b.cy GROUP BY a.g
 UNION ALL SELECT a.g, -count(*) FROM c a JOIN c b ON a.g=b.g AND a.cx=b.cx AND a.cy+1=b.cy GROUP BY a.g
 UNION ALL SELECT a.g, count(*) FROM c a JOIN c b ON a.g=b.g AND a.cx+1=b.cx AND a.cy=b.cy JOIN c e ON a.g=e.g AND a.cx=e.cx AND a.cy+1=e.cy JOIN c f ON a.g=f.g AND a.cx+1=f.cx AND a.cy+1=f.cy GROUP BY a.g) GROUP BY g)"""


@query(f"SELECT g, CAST(euler AS BIGINT) AS euler, area FROM {_RINGS} JOIN (SELECT g, CAST(count(*)*4 AS BIGINT) AS area FROM {_CELLS} GROUP BY g) USING (g)")
def road_outlines(spark, sf_dir):
    r = _roads(spark, sf_dir).select("g", F.explode("rings").alias("ring"))
    rings = topology.outlines(r, ("g",), 500.0)
    return rings.groupBy("g").agg(F.sum(F.signum("area")).cast("long").alias("euler"), F.round(F.sum("area")).cast("long").alias("area"))


#: Yards with courts: of w + 20 by 40, with c % 4 courts of 4 by 3 + i, of which those of at least 15 are kept.
@query("""SELECT g, count(*) AS faces, CAST(sum(k) AS BIGINT) AS holes, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(area) AS BIGINT) AS area FROM (SELECT g, k, greatest(0, k-1) AS kept, (20+c%7+20)*40 - k*12 - 4*(k*(k-1)//2) AS area FROM (SELECT c_custkey AS c, c_nationkey%5 AS g, c_custkey%4 AS k FROM customer)) GROUP BY g""")
def region_faces(spark, sf_dir):
    k = F.col("c_custkey")
    x, y, w = (v.cast("double") for v in (k % 1000 * 100, F.expr("c_custkey div 1000") * 100, 40 + k % 7))
    rect = lambda a, b, w, h: F.array(*(F.struct((x + p).alias("x"), (y + q).alias("y")) for p, q in ((a, b), (a + w, b), (a + w, b + h), (a, b + h))))
    court = lambda i: F.struct(rect(i.cast("double") * 8 + 4, d(5), d(4), (i + 3).cast("double")).alias("ring"), F.lit(True).alias("hole"))
    yard = F.array(F.struct(rect(d(0), d(0), w, d(40)).alias("ring"), F.lit(False).alias("hole")))
    parts = F.concat(yard, F.when(k % 4 > 0, F.transform(F.sequence(F.lit(0), (k % 4 - 1).cast("int")), court)).otherwise(F.slice(yard, 1, 0)))
    p = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("g"), F.explode(parts).alias("p")).select("g", "p.*")
    f = topology.faces(topology.outlines(p, ("g",), 130.0, holes=True), ("g",))
    area = F.abs(g.twice_area(F.col("outer"))) / 2 - F.aggregate(F.transform("inners", lambda r: F.abs(g.twice_area(r)) / 2), d(0), lambda a, v: a + v)
    return f.groupBy("g").agg(F.count("*").alias("faces"), F.sum(F.size("inners")).alias("holes"), F.sum(F.size(g.kept_holes(F.col("inners"), d(15.0)))).alias("kept"), F.round(F.sum(area)).cast("long").alias("area"))


_WATER = "(SELECT c_custkey AS k, c_nationkey%5 AS g, c_custkey*37%50*10 AS x, c_custkey*61%50*10 AS y FROM customer)"


@query(f"""SELECT g, CAST(count(*) AS BIGINT) AS area FROM (SELECT DISTINCT g, x+a AS cx, y+b AS cy FROM {_WATER}, (SELECT unnest(range(0,30)) AS a), (SELECT unnest(range(0,20)) AS b)) w
 WHERE NOT EXISTS (SELECT 1 FROM {_WATER} h WHERE h.g=w.g AND h.k%3=0 AND cx>=h.x+5 AND cx<h.x+15 AND cy>=h.y+5 AND cy<h.y+10) GROUP BY g""")
def water_difference(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = (k * 37 % 50 * 10).cast("double"), (k * 61 % 50 * 10).cast("double")
    rect = lambda a, b, w, h: F.array(*(F.struct((x + p).alias("x"), (y + q).alias("y")) for p, q in ((a, b), (a + w, b), (a + w, b + h), (a, b + h))))
    c = table(spark, sf_dir, "customer")
    own = c.select((F.col("c_nationkey") % 5).alias("g"), F.lit(False).alias("hole"), rect(0.0, 0.0, 30.0, 20.0).alias("ring"))
    islands = c.where("c_custkey % 3 = 0").select((F.col("c_nationkey") % 5).alias("g"), F.lit(True).alias("hole"), rect(5.0, 5.0, 10.0, 5.0).alias("ring"))
    return topology.dissolved(own.unionByName(islands), ("g",), 100.0, holes=True).groupBy("g").agg(srs.whole(F.sum("area"), 1.0).alias("area"))


@query(f"SELECT o_orderkey%10 AS layer, CAST(o_orderkey AS VARCHAR) AS id, 'Point' AS type, {_mm(LON.format(k='o_orderkey'), '1e6')} AS x6, o_orderpriority AS priority FROM orders")
def geojson_features(spark, sf_dir):
    lon, lat = lon_lat(F.col("o_orderkey"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("o_orderkey").alias("id"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(F.col("o_orderpriority").alias("priority"), F.lit("x").alias("PRIORITY2")).alias("properties"))
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10).alias("layer"), (F.col("o_orderkey") / 100).cast("int").alias("page"), F.to_json(feature).alias("f"))
    pages = rows.groupBy("layer", "page").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("payload"))
    read = payloads.geojson(pages)
    return read.select(F.col("source_layer").alias("layer"), "id", F.col("geometry.type").alias("type"), srs.whole(F.get("geometry.points", F.lit(0))["x"], 1e6).alias("x6"), F.element_at("attributes", F.lit("priority")).alias("priority"))


@query("SELECT o_orderkey AS id, 'way' AS type, o_orderkey%3=0 AS has_ring, CASE WHEN o_orderkey%2=0 THEN 'yes' END AS building FROM orders")
def osm_json_elements(spark, sf_dir):
    k = F.col("o_orderkey")
    lon, lat = lon_lat(k)
    at = lambda dx, dy: F.struct((lat + dy).alias("lat"), (lon + dx).alias("lon"))
    line = F.when(k % 3 == 0, F.array(at(0.0, 0.0), at(0.001, 0.0), at(0.001, 0.001))).otherwise(F.array(at(0.0, 0.0), at(0.001, 0.0)))
    element = F.struct(F.lit("way").alias("type"), k.alias("id"), F.when(k % 2 == 0, F.create_map(F.lit("building"), F.lit("yes"))).otherwise(F.create_map(F.lit("name"), F.lit("n"))).alias("tags"), line.alias("geometry"))
    rows = table(spark, sf_dir, "orders").select((k / 200).cast("int").alias("page"), F.to_json(element).alias("e"))
    pages = rows.groupBy("page").agg(F.concat(F.lit('{"elements":['), F.array_join(F.collect_list("e"), ","), F.lit("]}")).alias("payload"))
    e = payloads.osm_elements(pages)
    return e.select("id", "type", F.col("ring").isNotNull().alias("has_ring"), F.element_at("tags", F.lit("building")).alias("building"))
