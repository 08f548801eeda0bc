"""Queries over building masses, faces, placement and source choice, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import srs, text
from ..operators import diagnostics, massing
from .derived import CATALOG, LAT, LON, POINTS, TAGGED, boxes, boxes_sql, d, points, table, tagged
from .derived import catalog as layers_of
from .site import _CATEGORY, _HEIGHT, _classified
from .spatial import _X32, _Y32, _mm

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_H = f"greatest(COALESCE({_HEIGHT}, CAST(k*3 AS DOUBLE)), CAST(4 AS DOUBLE))"


@query(f"SELECT id, CAST(200 AS BIGINT) AS area, 100000 AS base_mm, {_mm(f'(CAST(100 AS DOUBLE)+{_H})')} AS top_mm, {_mm(f'({_H}*200)', '1')} AS volume FROM {TAGGED} WHERE t='signup'")
def building_mass(spark, sf_dir):
    x = (F.col("id") % 1000).cast("double")
    ring = F.array(*(F.struct((x + a).alias("x"), d(b).alias("y")) for a, b in ((0.0, 0), (20.0, 0), (20.0, 10), (0.0, 10))))
    m = tagged(spark, sf_dir).where("event_type = 'signup'").select("id", massing.mass(ring, F.col("tags"), d(100.0)).alias("m"))
    return m.select("id", F.col("m.area").cast("long").alias("area"), srs.whole(F.col("m.base")).alias("base_mm"), srs.whole(F.col("m.top")).alias("top_mm"), srs.whole(F.col("m.volume"), 1.0).alias("volume"))


@query("SELECT n_nationkey, CASE n_nationkey%4 WHEN 0 THEN '0,1,2' WHEN 1 THEN '0,1,2,3' WHEN 2 THEN '0,1,2;0,2,3' ELSE '0,1,2;0,2,3;0,3,4' END AS faces FROM nation")
def face_strategy(spark, sf_dir):
    k = F.col("n_nationkey")
    p = lambda x, y, z: F.struct(d(x).alias("x"), d(y).alias("y"), d(z).alias("z"))
    rings = [F.array(p(0, 0, 0), p(1, 0, 0), p(0, 1, 0)), F.array(p(0, 0, 1), p(1, 0, 1), p(1, 1, 1), p(0, 1, 1)), F.array(p(0, 0, 0), p(2, 0, 1), p(2, 2, 0), p(-1, 3, 1)), F.array(p(0, 0, 0), p(2, 0, 1), p(3, 2, 0), p(1, 3, 1), p(-1, 1, 0))]
    ring = F.when(k % 4 == 0, rings[0]).when(k % 4 == 1, rings[1]).when(k % 4 == 2, rings[2]).otherwise(rings[3])
    f = massing.faces(ring)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(f, lambda c: F.array_join(c.cast("array<string>"), ",")), ";").alias("faces"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey%2=0 THEN 4 ELSE 5 END AS corners FROM nation")
def ring_simplify(spark, sf_dir):
    k = F.col("n_nationkey")
    p = lambda x, y: F.struct(d(x).alias("x"), y.alias("y"))
    ring = F.array(p(0, d(0)), p(5, F.when(k % 2 == 0, d(0.0)).otherwise(d(1.0))), p(10, d(0)), p(10, d(10)), p(0, d(10)))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.size(massing.without_collinear(ring)).alias("corners"))


@query(f"SELECT id, {_mm(f'({_X32} - CAST(460000 AS DOUBLE))')} AS x_mm, {_mm(f'({_Y32} - CAST(5530000 AS DOUBLE))')} AS y_mm, true AS rejected FROM {POINTS}")
def polyline_place(spark, sf_dir):
    line = F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")), F.struct((F.col("lon") + 0.001).alias("x"), F.col("lat").alias("y")))
    start = F.struct(d(460000.0).alias("x"), d(5530000.0).alias("y"))
    moved = massing.placed_line(line, "EPSG:4326", "EPSG:25832", start)
    broken = massing.placed_line(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")), F.struct(F.lit(None).cast("double").alias("x"), d(1.0).alias("y"))), "EPSG:4326", "EPSG:27700", start)
    return points(spark, sf_dir).select("id", srs.whole(F.get(moved, F.lit(0))["x"]).alias("x_mm"), srs.whole(F.get(moved, F.lit(0))["y"]).alias("y_mm"), broken.isNull().alias("rejected"))


@query("SELECT n_nationkey, n_nationkey*1000+500 AS x_mm, CASE WHEN n_nationkey%5=0 THEN true ELSE false END AS flat FROM nation")
def affine_fallback(spark, sf_dir):
    k = F.col("n_nationkey").cast("double")
    box = lambda x0, x1: F.struct(x0.alias("min_x"), d(0.0).alias("min_y"), x1.alias("max_x"), d(2.0).alias("max_y"))
    p = F.struct(d(5.0).alias("x"), d(1.0).alias("y"))
    moved = massing.by_boxes(p, box(d(0.0), d(10.0)), box(k, k + 1))
    flat = massing.by_boxes(p, box(d(0.0), F.when(F.col("n_nationkey") % 5 == 0, d(0.0)).otherwise(d(1.0))), box(k, k + 1))
    return table(spark, sf_dir, "nation").select("n_nationkey", srs.whole(moved["x"]).alias("x_mm"), flat.isNull().alias("flat"))


@query(f"SELECT n_nationkey, corner, {_mm('CASE WHEN corner IN (1,2) THEN max_x ELSE min_x END', '1e7')} AS x7, CASE WHEN corner IN (2,3) THEN 1 ELSE 0 END AS v FROM {boxes_sql('nation', 'n_nationkey', 'n_nationkey')}, (SELECT unnest(range(0,4))::INTEGER AS corner)")
def image_quads(spark, sf_dir):
    q = boxes(table(spark, sf_dir, "nation"), "n_nationkey").select("n_nationkey", F.posexplode(massing.image_quad(F.col("box"), d(0.0))).alias("corner", "c"))
    return q.select("n_nationkey", "corner", srs.whole(F.col("c.x"), 1e7).alias("x7"), F.col("c.v").cast("int").alias("v"))


@query("SELECT n_nationkey, n_nationkey%6 IN (0,1,2,3) AS transient, CASE WHEN n_nationkey%3=0 THEN 'user' WHEN n_nationkey%3=1 THEN 'built-in' ELSE 'fallback' END AS tier, 'EPSG:25832|'||n_nationkey||'.000000|0.500000|'||(n_nationkey+1)||'.000000|2.250000' AS key FROM nation")
def source_resolution(spark, sf_dir):
    k = F.col("n_nationkey")
    status = F.element_at(F.array(F.lit(None).cast("int"), F.lit(503), F.lit(429), F.lit(400), F.lit(404), F.lit(200)), (k % 6 + 1).cast("int"))
    message = F.when(k % 6 == 3, "the operation timed out").otherwise("no")
    source = massing.resolved_source(F.when(k % 3 == 0, "http://own ").otherwise(" "), F.when(k % 3 == 1, "http://built-in"), F.lit("http://fallback"))
    box = F.struct(k.cast("double").alias("min_x"), d(0.5).alias("min_y"), (k + 1).cast("double").alias("max_x"), d(2.25).alias("max_y"))
    return table(spark, sf_dir, "nation").select("n_nationkey", massing.is_transient(status, message).alias("transient"), source["tier"].alias("tier"), massing.context_key(F.lit("EPSG:25832"), box).alias("key"))


@query(f"""SELECT s_suppkey, CASE WHEN has THEN wanted ELSE first END AS coverage FROM (SELECT s_suppkey, wanted, EXISTS (SELECT 1 FROM {CATALOG} c WHERE c.service=s.service AND c.title=wanted) AS has, (SELECT arg_min(title, seq) FROM {CATALOG} c WHERE c.service=s.service) AS first
 FROM (SELECT s_suppkey, CAST(s_suppkey%8 AS INTEGER) AS service, 'plain '||(SELECT min(p_type) FROM part) AS wanted FROM supplier) s)""")
def coverage_choice(spark, sf_dir):
    least = table(spark, sf_dir, "part").agg(F.min("p_type")).scalar()
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 8).cast("int").alias("service"), F.concat(F.lit("plain "), least).alias("wanted"))
    return massing.chosen_coverage(asked, layers_of(spark, sf_dir).select("service", "title", "seq"), "service", "wanted", "title", "seq").select("s_suppkey", "coverage")


@query("SELECT n_nationkey, CASE n_nationkey%3 WHEN 0 THEN 'EPSG:7423' WHEN 1 THEN 'EPSG:4326' ELSE 'EPSG:25833' END AS srs, CASE n_nationkey%4 WHEN 0 THEN 1234500 WHEN 1 THEN -2000 WHEN 2 THEN NULL ELSE 1000000 END AS parsed_k FROM nation")
def request_srs(spark, sf_dir):
    k = F.col("n_nationkey")
    names = F.when(k % 3 == 0, F.array(F.lit("EPSG:4326"), F.lit("urn:7423"))).when(k % 3 == 1, F.array(F.lit("EPSG:25832"), F.lit("EPSG:4326"))).otherwise(F.array(F.lit("EPSG:3857")))
    number = text.number(F.element_at(F.array(*map(F.lit, ("1,234.5", " -2 ", "1f", "1e3"))), (k % 4 + 1).cast("int")))
    return table(spark, sf_dir, "nation").select("n_nationkey", massing.request_srs(names, F.lit("epsg:25833")).alias("srs"), srs.whole(number).alias("parsed_k"))


@query(f"""SELECT g, CAST(sum(n) AS BIGINT) AS features, COALESCE(string_agg(CASE WHEN category='water' THEN category END, ', ' ORDER BY category), '') AS unavailable, CASE WHEN sum(n)=0 OR bool_or(category='water') THEN 'warning' WHEN bool_or(category='rail') THEN 'remark' ELSE 'ok' END AS level
 FROM (SELECT g, category, count(*) AS n FROM (SELECT user_id%50 AS g, {_CATEGORY} AS category FROM {TAGGED}) WHERE category IS NOT NULL GROUP BY g, category) GROUP BY g""")
def diag_osm_status(spark, sf_dir):
    c = _classified(spark, sf_dir).where("category is not null").groupBy((F.col("user_id") % 50).alias("g"), "category").agg(F.count("*").alias("n"))
    s = diagnostics.categories(c.withColumn("gone", F.col("category") == "water").withColumn("old", F.col("category") == "rail"), ("g",), "gone", "old")
    return s.select("g", "features", "unavailable", "level")
