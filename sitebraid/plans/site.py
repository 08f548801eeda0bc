"""Queries over tagged elements, terrain, rasters, geometry, surfaces and caches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import requests, srs, text
from ..operators import osm, raster, surfaces, terrain
from .derived import GRID, LAT, LON, POINTS, TAGGED, boxes, boxes_sql, d, grid, lon_lat, points, table, tagged
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


_ROADS = ",".join(f"'{r}'" for r in osm.ROAD_WIDTHS)
_CATEGORY = f"""CASE WHEN t NOT IN ('signup','purchase','view','click') THEN NULL WHEN trim(building)<>'' THEN CASE WHEN area THEN 'buildings' END WHEN highway IN ({_ROADS}) AND line THEN 'roads'
 WHEN area AND lower(natural_)='water' AND NOT (lower(intermittent)='yes' OR (trim(tunnel)<>'' AND lower(tunnel)<>'no')) THEN 'water'
 WHEN area AND (lower(leisure)='park' OR natural_ IN ('wood','grassland')) THEN 'green' WHEN railway IN ('rail','light_rail','tram','narrow_gauge') AND covered<>'yes' AND line THEN 'rail' END"""


def _classified(spark, sf_dir):
    e = tagged(spark, sf_dir)
    return e.withColumn("category", osm.category(F.col("tags"), F.col("area"), F.col("line")))


@query(f"SELECT id, {_CATEGORY} AS category FROM {TAGGED}")
def osm_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("id", "category")


@query(f"SELECT category, count(*) AS n, sum(k) AS k_sum FROM (SELECT k, {_CATEGORY} AS category FROM {TAGGED}) WHERE category IS NOT NULL GROUP BY category")
def osm_category_counts(spark, sf_dir):
    return _classified(spark, sf_dir).where("category is not null").groupBy("category").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


@query(f"SELECT id, COALESCE(t='view' AND (lower(intermittent)='yes' OR (trim(tunnel)<>'' AND lower(tunnel)<>'no')), false) OR COALESCE(t='click' AND covered='yes', false) AS hidden FROM {TAGGED}")
def osm_water_exclusions(spark, sf_dir):
    return tagged(spark, sf_dir).select("id", osm.is_hidden_water(F.col("tags")).alias("hidden"))


@query(f"SELECT id, COALESCE(railway IN ('rail','tram') AND covered<>'yes', false) AS rail FROM {TAGGED}")
def osm_rail(spark, sf_dir):
    return tagged(spark, sf_dir).select("id", osm.is_rail(F.col("tags")).alias("rail"))


_HEIGHT = "CASE k%4 WHEN 0 THEN CAST(k AS DOUBLE)*CAST(0.3048 AS DOUBLE) WHEN 1 THEN CAST(k AS DOUBLE)+CAST(0.5 AS DOUBLE) WHEN 3 THEN CAST(k AS DOUBLE)*CAST(0.3048 AS DOUBLE) END"


@query(f"SELECT id, {_mm(f'greatest(COALESCE({_HEIGHT}, CAST(k*3 AS DOUBLE)), CAST(4 AS DOUBLE))')} AS height_mm, 0 AS base_mm FROM {TAGGED} WHERE t='signup'")
def osm_building_height(spark, sf_dir):
    e = tagged(spark, sf_dir).where("event_type = 'signup'")
    return e.select("id", srs.whole(osm.building_height(F.col("tags"))).alias("height_mm"), srs.whole(osm.building_base(F.col("tags"))).alias("base_mm"))


_CLASS = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in osm.ROAD_WIDTHS.items()) + " ELSE 8 END"
_WIDTH = f"CASE WHEN k%5=0 THEN greatest(CAST(k AS DOUBLE), 4) WHEN k%3=0 THEN greatest(k*CAST(3.25 AS DOUBLE), 6) ELSE CAST({_CLASS} AS DOUBLE) END"


@query(f"SELECT id, {_mm(_WIDTH)} AS width_mm FROM {TAGGED} WHERE t='purchase'")
def osm_road_width(spark, sf_dir):
    return tagged(spark, sf_dir).where("event_type = 'purchase'").select("id", srs.whole(osm.road_width(F.col("tags"))).alias("width_mm"))


@query("""SELECT n_nationkey, CAST(floor((CASE n_nationkey%6 WHEN 0 THEN CAST(12.5 AS DOUBLE) WHEN 1 THEN CAST(7.25 AS DOUBLE) WHEN 2 THEN CAST(30 AS DOUBLE)*CAST(0.3048 AS DOUBLE) WHEN 3 THEN CAST(5 AS DOUBLE)*CAST(0.3048 AS DOUBLE) WHEN 4 THEN CAST(-3 AS DOUBLE) END)*1000+0.5) AS BIGINT) AS mm FROM nation""")
def osm_tag_length(spark, sf_dir):
    t = F.element_at(F.array(*map(F.lit, ("12.5 m", "7,25", "30 ft", "5'11\"", "-3", "high"))), (F.col("n_nationkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", srs.whole(text.osm_length(t)).alias("mm"))


@query(f"""SELECT g, {_mm('COALESCE(w, CAST(6 AS DOUBLE))')} AS width_mm, {_mm('greatest(CAST(0.9 AS DOUBLE), least(COALESCE(w,6)*CAST(0.24 AS DOUBLE), 6))')} AS cleanup_mm FROM (SELECT g, list_sort(list(w) FILTER (w > 0.01))[count(*) FILTER (w > 0.01)//2+1] AS w FROM (SELECT user_id%20 AS g, {_WIDTH} AS w FROM {TAGGED} WHERE t='purchase') GROUP BY g)""")
def osm_road_upper_median(spark, sf_dir):
    r = tagged(spark, sf_dir).where("event_type = 'purchase'").select((F.col("user_id") % 20).alias("g"), osm.road_width(F.col("tags")).alias("w"))
    m = osm.typical_width(r, ("g",), "w", 0.01)
    return m.select("g", srs.whole(F.col("width")).alias("width_mm"), srs.whole(osm.clean_up(F.col("width"), 0.01)["cleanup"]).alias("cleanup_mm"))


@query("SELECT id, min(event_id) AS first_seen, arg_max(event_type, event_id) AS event_type FROM (SELECT user_id AS id, event_id, event_type FROM events) GROUP BY id")
def osm_merge_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "event_type")
    return osm.merge_last(e, "id", "event_id").select("id", "first_seen", "event_type")


_WIDE = "(SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS min_x, CAST(50 AS DOUBLE) AS min_y, CAST(n_nationkey AS DOUBLE) + CAST(n_nationkey%6+1 AS DOUBLE)/512 AS max_x, CAST(50 AS DOUBLE) + CAST(n_nationkey%4+1 AS DOUBLE)/256 AS max_y FROM nation)"


def _wide(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").withColumn("box", F.struct(k.cast("double").alias("min_x"), d(50.0).alias("min_y"), (k.cast("double") + (k % 6 + 1).cast("double") / 512).alias("max_x"), (d(50.0) + (k % 4 + 1).cast("double") / 256).alias("max_y")))


@query(f"""SELECT n_nationkey, iy, ix, {_mm('min_x+(max_x-min_x)/nx*ix', '1e7')} AS x0, {_mm('CASE WHEN iy=ny-1 THEN max_y ELSE min_y+(max_y-min_y)/ny*(iy+1) END', '1e7')} AS y1 FROM
 (SELECT *, unnest(range(0, nx))::INTEGER AS ix FROM (SELECT *, unnest(range(0, ny))::INTEGER AS iy FROM (SELECT *, CAST(least(4, greatest(1, ceil((max_x-min_x)/CAST(0.0035 AS DOUBLE)))) AS INTEGER) AS nx, CAST(least(4, greatest(1, ceil((max_y-min_y)/CAST(0.0035 AS DOUBLE)))) AS INTEGER) AS ny FROM {_WIDE})))""".replace("min_x+(max_x-min_x)/nx*ix", "(min_x+(max_x-min_x)/nx*ix)").replace("CASE WHEN iy=ny-1", "(CASE WHEN iy=ny-1").replace("(iy+1) END", "(iy+1) END)"))
def osm_tile_plan(spark, sf_dir):
    t = osm.tiles(_wide(spark, sf_dir), "box", d(requests.TILE_EDGE["water"]))
    return t.select("n_nationkey", "iy", "ix", srs.whole(F.col("tile.min_x"), 1e7).alias("x0"), srs.whole(F.col("tile.max_y"), 1e7).alias("y1"))


@query(f"SELECT n_nationkey, n_nationkey%3<>0 AND (1 + (n_nationkey%2) + CASE WHEN n_nationkey%3=0 THEN 1 ELSE 0 END) > 1 AND max_x-min_x <= CAST(0.0045 AS DOUBLE) AND max_y-min_y <= CAST(0.0045 AS DOUBLE) AS combined FROM {_WIDE}")
def osm_batch_plan(spark, sf_dir):
    k = F.col("n_nationkey")
    wanted = {"buildings": F.lit(True), "roads": k % 2 == 1, "water": k % 3 == 0}
    return _wide(spark, sf_dir).select("n_nationkey", osm.combined(F.col("box"), wanted).alias("combined"))


def _overpass_sql() -> str:
    where = "'(50.5,'||n_nationkey||',51,'||(n_nationkey+1)||');'"
    part = lambda c: "||".join(f"'{kind}[{tag}]'||{where}" for kinds, tag in requests.OSM_FILTERS[c] for kind in kinds)
    return f"SELECT n_nationkey, '[out:json][timeout:'||greatest(10, n_nationkey)||'];('||{part('buildings')}||CASE WHEN n_nationkey%2=0 THEN {part('roads')} ELSE '' END||CASE WHEN n_nationkey%3=0 THEN {part('water')}||{part('green')} ELSE '' END||{part('rail')}||');out geom;' AS ql FROM nation"


@query(_overpass_sql())
def osm_overpass_ql(spark, sf_dir):
    k = F.col("n_nationkey")
    b = F.struct(k.cast("double").alias("min_x"), d(50.5).alias("min_y"), (k + 1).cast("double").alias("max_x"), d(51.0).alias("max_y"))
    wanted = {"buildings": F.lit(True), "roads": k % 2 == 0, "water": k % 3 == 0, "green": k % 3 == 0, "rail": F.lit(True)}
    return table(spark, sf_dir, "nation").select("n_nationkey", requests.overpass(b, wanted, k).alias("ql"))


@query(f"""SELECT raster_id, count(*) AS n, CAST(sum(CASE WHEN z > 0 THEN z ELSE 0 END) AS BIGINT) AS z_sum, max("col"//sx) AS most_x FROM (SELECT *, CAST(ceil(width/CAST(16 AS DOUBLE)) AS INTEGER) AS sx, CAST(ceil(height/CAST(16 AS DOUBLE)) AS INTEGER) AS sy FROM {GRID}) WHERE "col"%sx=0 AND "row"%sy=0 GROUP BY raster_id""")
def terrain_downsample(spark, sf_dir):
    s = terrain.downsampled(grid(spark, sf_dir), "width", "height", 16)
    return s.groupBy("raster_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("z") > 0, F.col("z")).otherwise(0.0)).cast("long").alias("z_sum"), F.max("sample_x").alias("most_x"))


@query("SELECT k, s, a, a+1 AS b, a+s+1 AS c, a+s AS d FROM (SELECT k, s, qy*s+qx AS a FROM (SELECT k, s, qy, unnest(range(0, s-1)) AS qx FROM (SELECT k, s, unnest(range(0, s)) AS qy FROM (SELECT s_suppkey AS k, 2+s_suppkey%10 AS s FROM supplier))))")
def terrain_mesh_faces(spark, sf_dir):
    k = F.col("s_suppkey")
    sizes = table(spark, sf_dir, "supplier").select(k.alias("k"), (k % 10 + 2).cast("int").alias("s"), (k % 10 + 3).cast("int").alias("h"))
    return terrain.faces(sizes, "s", "h").select("k", "s", "a", "b", "c", "d")


@query(f"SELECT raster_id, CAST(COALESCE(min(CASE WHEN abs(z+9999) < 0.001 THEN NULL ELSE z END),0) AS BIGINT) AS baseline FROM {GRID} GROUP BY raster_id")
def terrain_baseline(spark, sf_dir):
    return terrain.baseline(grid(spark, sf_dir), ("raster_id",), d(-9999.0)).select("raster_id", F.col("baseline").cast("long").alias("baseline"))


def _sample_points(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select(F.col("id").alias("point_id"), (F.col("id") % 4).cast("int").alias("raster_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), "nation")


def _sampled(spark, sf_dir):
    cells = grid(spark, sf_dir)
    box = F.struct(d(8.45).alias("min_x"), d(50.0).alias("min_y"), d(8.75).alias("max_x"), d(50.2).alias("max_y"))
    rasters = cells.where("row = 0 and col = 0").select("raster_id", "width", "height").withColumn("box", box)
    return terrain.sampled(_sample_points(spark, sf_dir), cells, rasters, d(-9999.0))


_SAMPLED = f"""(SELECT id AS point_id, nation, CASE WHEN a > 0 AND b > 0 AND c > 0 AND e > 0 THEN (1-u)*(1-v)*a + u*(1-v)*b + (1-u)*v*c + u*v*e END AS z FROM
 (SELECT id, nation, u, v, max(z) FILTER (dr=0 AND dc=0) AS a, max(z) FILTER (dr=0 AND dc=1) AS b, max(z) FILTER (dr=1 AND dc=0) AS c, max(z) FILTER (dr=1 AND dc=1) AS e FROM
 (SELECT id, nation, u, v, dr, dc, g.z FROM (SELECT *, r0+dr AS y, c0+dc AS x FROM (SELECT *, unnest([0,0,1,1]) AS dr, unnest([0,1,0,1]) AS dc FROM
 (SELECT *, fx-c0 AS u, fy-r0 AS v FROM (SELECT *, least(CAST(floor(fx) AS INTEGER), w-2) AS c0, least(CAST(floor(fy) AS INTEGER), h-2) AS r0 FROM (SELECT *, (lon-CAST(8.45 AS DOUBLE))/(CAST(8.75 AS DOUBLE)-CAST(8.45 AS DOUBLE))*(w-1) AS fx, (CAST(50.2 AS DOUBLE)-lat)/(CAST(50.2 AS DOUBLE)-CAST(50 AS DOUBLE))*(h-1) AS fy
  FROM (SELECT *, CAST(id%4 AS INTEGER) AS r, CAST(40+10*(id%4) AS INTEGER) AS w, CAST(30+5*(id%4) AS INTEGER) AS h FROM {POINTS}) WHERE lon BETWEEN CAST(8.45 AS DOUBLE) AND CAST(8.75 AS DOUBLE) AND lat BETWEEN CAST(50 AS DOUBLE) AND CAST(50.2 AS DOUBLE)))))) p JOIN {GRID} g ON g.raster_id=p.r AND g."row"=p.y AND g.col=p.x) GROUP BY id, nation, u, v))"""


@query(f"SELECT p.id AS point_id, {_mm('s.z')} AS z_mm FROM {POINTS} p LEFT JOIN {_SAMPLED} s ON p.id = s.point_id")
def terrain_bilinear_sample(spark, sf_dir):
    return _sampled(spark, sf_dir).select("point_id", srs.whole(F.col("z")).alias("z_mm"))


@query(f"SELECT nation, CAST(floor(COALESCE(avg(s.z),0)*100+0.5) AS BIGINT) AS z_cm, count(s.z) AS samples FROM {POINTS} p LEFT JOIN {_SAMPLED} s ON p.id = s.point_id GROUP BY nation".replace("SELECT nation", "SELECT p.nation").replace("GROUP BY nation", "GROUP BY p.nation"))
def terrain_avg_elevation(spark, sf_dir):
    return terrain.average(_sampled(spark, sf_dir), ("nation",)).select("nation", srs.whole(F.col("elevation"), 100.0).alias("z_cm"), "samples")


@query("SELECT user_id, CAST(floor(arg_min(value, event_id)*100+0.5) AS BIGINT) AS value_c FROM events WHERE value IS NOT NULL GROUP BY user_id")
def elevation_baseline_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    return terrain.first_baseline(e, "user_id", "value", "event_id").select("user_id", srs.whole(F.col("value"), 100.0).alias("value_c"))


#: Boxes of side 2048 at whole numbers, the second moved by 1024 * (k % 5) and half of that: their edges meet exactly at k % 5 = 2.
_PAIR = "(SELECT s_suppkey, s_suppkey*37%1000 AS x, s_suppkey*61%1000 AS y, s_suppkey%5*1024 AS o FROM supplier)"
_PAIR2 = f"(SELECT *, greatest(0, least(x, x+o) + 2048 - greatest(x, x+o)) AS w, greatest(0, least(y, y+o//2) + 2048 - greatest(y, y+o//2)) AS h FROM {_PAIR})"


def _pair(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y, o = (k * 37 % 1000).cast("double"), (k * 61 % 1000).cast("double"), (k % 5 * 1024).cast("double")
    side = lambda x, y: F.struct(x.alias("min_x"), y.alias("min_y"), (x + d(2048)).alias("max_x"), (y + d(2048)).alias("max_y"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", side(x, y).alias("a"), side(x + o, y + o / 2).alias("b"))


@query(f"SELECT s_suppkey, CAST(floor(CAST(w*h AS DOUBLE)/4194304*1000+0.5) AS BIGINT) AS ratio_k, NOT (x+2048 < x+o OR y+2048 < y+o//2) AS meet FROM {_PAIR2}")
def bbox_intersection_ratio(spark, sf_dir):
    return _pair(spark, sf_dir).select("s_suppkey", srs.whole(raster.overlap(F.col("a"), F.col("b"))).alias("ratio_k"), g.boxes_meet(F.col("a"), F.col("b")).alias("meet"))


@query(f"SELECT s_suppkey, CASE WHEN w*h=4194304 THEN 0 WHEN w*h>0 THEN CAST(o*1000 AS BIGINT)//2048 END AS u0, CASE WHEN w*h>0 THEN 1000 END AS v1, CASE WHEN w*h=4194304 THEN 0 WHEN w*h>0 THEN CAST(o//2*1000 AS BIGINT)//2048 END AS v0 FROM {_PAIR2}")
def geotiff_clip_uv(spark, sf_dir):
    c = _pair(spark, sf_dir).select("s_suppkey", raster.clip_window(F.col("a"), F.col("b")).alias("c"))
    return c.select("s_suppkey", *(srs.whole(F.col(f"c.{n}")).alias(n) for n in ("u0", "v1", "v0")))


@query("""SELECT s_suppkey, s_suppkey*1000 AS x0, 5500000000 - (100+s_suppkey)*500 AS y0, CASE WHEN s_suppkey%7=0 THEN NULL ELSE s_suppkey*1000+200*500 END AS affine_x1, (20000+s_suppkey)*CAST(2000 AS BIGINT) > 40000000 OR s_suppkey*1000000 > 209715200 AS large FROM supplier""")
def geotiff_bbox(spark, sf_dir):
    k = F.col("s_suppkey")
    w, h = F.lit(200), (k + 100).cast("int")
    a = raster.box_from_tiepoint(w, h, F.array(d(0.5), d(0.5), d(0.0)), F.array(d(0.0), d(0.0), d(0.0), k.cast("double"), d(5500000.0), d(0.0)))
    m = F.array(d(0.5), F.when(k % 7 == 0, d(0.1)).otherwise(d(0.0)), d(0.0), k.cast("double"), d(0.0), d(-0.5), d(0.0), d(5500000.0))
    b = raster.box_from_affine(w, h, m)
    return table(spark, sf_dir, "supplier").select("s_suppkey", srs.whole(a["min_x"]).alias("x0"), srs.whole(a["min_y"]).alias("y0"), srs.whole(b["max_x"]).alias("affine_x1"), raster.is_large((k + 20000).cast("int"), F.lit(2000), k * 1000000).alias("large"))


def _rings(spark, sf_dir):
    v = F.col("embedding")
    p = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(F.floor(F.get(v, i * 2).cast("double") * d(1000)).alias("x"), F.floor(F.get(v, i * 2 + 1).cast("double") * d(1000)).alias("y")))
    p = F.transform(p, lambda q: F.struct(q["x"].cast("double").alias("x"), q["y"].cast("double").alias("y"), d(0.0).alias("z")))
    return table(spark, sf_dir, "embeddings").select("vec_id", p.alias("ring"))


_RING = "(SELECT vec_id, list_transform(range(1,17), lambda i: CAST(floor(CAST(embedding[2*i-1] AS DOUBLE)*1000) AS BIGINT)) AS xs, list_transform(range(1,17), lambda i: CAST(floor(CAST(embedding[2*i] AS DOUBLE)*1000) AS BIGINT)) AS ys FROM embeddings)"


@query(f"SELECT vec_id, CAST(list_sum(list_transform(range(1,17), lambda i: xs[i]*ys[i%16+1]-xs[i%16+1]*ys[i])) AS BIGINT) AS twice_area FROM {_RING}")
def ring_shoelace(spark, sf_dir):
    return _rings(spark, sf_dir).select("vec_id", g.twice_area(F.col("ring")).cast("long").alias("twice_area"))


@query(f"SELECT vec_id, xs[1]=xs[16] AND ys[1]=ys[16] AS closed, CASE WHEN xs[1]=xs[16] AND ys[1]=ys[16] THEN 16 ELSE 17 END AS n FROM {_RING}")
def ring_closed(spark, sf_dir):
    return _rings(spark, sf_dir).select("vec_id", g.is_closed(F.col("ring")).alias("closed"), F.size(g.close(F.col("ring"))).alias("n"))


@query(f"SELECT vec_id, list_min(xs) AS x0, list_min(ys) AS y0, list_max(xs) AS x1, list_max(ys) AS y1 FROM {_RING}")
def ring_bbox(spark, sf_dir):
    b = g.box(F.col("ring"))
    return _rings(spark, sf_dir).select("vec_id", *(b[c].cast("long").alias(n) for c, n in (("min_x", "x0"), ("min_y", "y0"), ("max_x", "x1"), ("max_y", "y1"))))


_KEYS = f"(SELECT vec_id, list_transform(range(1,17), lambda i: xs[i]||'|'||ys[i]||'|0') AS ks FROM {_RING})"
_KEYS2 = f"(SELECT vec_id, CASE WHEN ks[1]=ks[16] THEN ks[1:15] ELSE ks END AS ks FROM {_KEYS})"


@query(f"""SELECT vec_id, least(list_min(list_transform(range(1,len(ks)+1), lambda i: array_to_string(list_concat(ks[i:len(ks)], ks[1:i-1]),';'))), list_min(list_transform(range(1,len(ks)+1), lambda i: array_to_string(list_concat(list_reverse(ks)[i:len(ks)], list_reverse(ks)[1:i-1]),';')))) AS key FROM {_KEYS2}""")
def ring_canonical_key(spark, sf_dir):
    return _rings(spark, sf_dir).select("vec_id", g.ring_key(F.col("ring"), 1.0).alias("key"))


@query(f"SELECT id, 2 AS n2, {_mm('lon', '1e6')} AS x2, 2 AS n3, id%9 AS z3, 1 AS partial_n FROM {POINTS}")
def poslist_parse(spark, sf_dir):
    t = F.format_string("%.10f %.10f  1 2", F.col("lon"), F.col("lat"))
    t3 = F.format_string("%.10f %.10f %d 4 5 6", F.col("lon"), F.col("lat"), F.col("id") % 9)
    bad = F.lit("1 x 3 4")
    p2, p3 = g.points_2d(t), g.points_3d(t3, F.lit(None).cast("int"), F.lit("EPSG:7423"))
    return points(spark, sf_dir).select("id", F.size(p2).alias("n2"), srs.whole(F.get(p2, F.lit(0))["x"], 1e6).alias("x2"), F.size(p3).alias("n3"), F.get(p3, F.lit(0))["z"].cast("long").alias("z3"), F.size(g.points_2d(bad)).alias("partial_n"))


@query(f"SELECT id, CASE WHEN id%2=0 THEN id ELSE 5000000+id END AS wfs_x, {_mm('lon', '1e6')} AS lod_x FROM {POINTS}")
def axis_swap(spark, sf_dir):
    k = F.col("id").cast("double")
    north = g.swapped_north_first(F.struct((k + 5000000.0).alias("x"), k.alias("y")), F.when(F.col("id") % 2 == 0, "urn:epsg:25832").otherwise("local"))
    lat_first = g.swapped_lat_first(F.struct(F.col("lat").alias("x"), F.col("lon").alias("y")), F.lit("EPSG:7423"))
    return points(spark, sf_dir).select("id", north["x"].cast("long").alias("wfs_x"), srs.whole(lat_first["x"], 1e6).alias("lod_x"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity/2, 0) AS BIGINT) AS half_even FROM lineitem")
def quantize_rint(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", g.quantize(F.col("l_quantity"), 2.0).alias("half_even"))


def _faces(spark, sf_dir):
    """Faces of boxes, an order each: line 1..6 gives a side of a cube, repeated sides start at another vertex."""
    k, side, turn = F.col("l_orderkey"), (F.col("l_partkey") % 6).cast("int"), (F.col("l_suppkey") % 4).cast("int")
    corner = lambda x, y, z: F.struct(d(x).alias("x"), d(y).alias("y"), d(z).alias("z"))
    cubes = [((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)), ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)), ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)), ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)), ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)), ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1))]
    sides = F.array(*(F.array(*(corner(*p) for p in c)) for c in cubes))  # a constant
    place = lambda i: (F.when(F.col("l_linenumber") % 2 == 0, F.lit(3) - i).otherwise(i) + turn) % 4

    def point(i):
        p = F.get(F.get(sides, side), place(i))
        return F.struct((k.cast("double") + p["x"]).alias("x"), p["y"].alias("y"), p["z"].alias("z"))

    ring = F.transform(F.sequence(F.lit(0), F.lit(3)), point)
    return table(spark, sf_dir, "lineitem").select(k.alias("building"), F.col("l_linenumber").alias("line"), side.alias("side"), ring.alias("outer"), F.expr("cast(array() as array<array<struct<x:double,y:double,z:double>>>)").alias("inners"))


_FACES = "(SELECT l_orderkey AS building, l_linenumber AS line, l_partkey%6 AS side FROM lineitem)"


@query(f"SELECT building, side, min(line) AS line FROM {_FACES} GROUP BY building, side")
def surface_dedup(spark, sf_dir):
    return surfaces.distinct_surfaces(_faces(spark, sf_dir), "building", "line").select("building", "side", "line")


_EDGES = """(SELECT unnest([0,0,0,0,1,1,1,1,2,2,2,2,3,3,3,3,4,4,4,4,5,5,5,5]) AS side, unnest(['000-010','010-110','100-110','000-100','001-101','101-111','011-111','001-011','000-100','100-101','001-101','000-001','010-011','011-111','110-111','010-110','000-001','001-011','010-011','000-010','100-110','110-111','101-111','100-101']) AS e)"""


@query(f"""SELECT building, count(*) AS edges, count(*) FILTER (n=1) AS naked, count(*) FILTER (n=2) AS manifold, count(*) FILTER (n>2) AS nonmanifold, count(*) FILTER (n<>2)=0 AS closed FROM (SELECT building, e, count(*) AS n FROM (SELECT DISTINCT building, side FROM {_FACES}) f JOIN {_EDGES} x ON f.side=x.side GROUP BY building, e) GROUP BY building""")
def edge_topology(spark, sf_dir):
    return surfaces.topology(surfaces.distinct_edges(_faces(spark, sf_dir), "building", "line"), "building")


@query(f"""SELECT building, shell, count(*) AS n FROM (SELECT building, side, CASE WHEN len(sides)=2 AND sides IN ([0,1],[2,3],[4,5]) THEN side ELSE sides[1] END AS shell FROM (SELECT f.building, f.side, s.sides FROM (SELECT DISTINCT building, side FROM {_FACES}) f JOIN (SELECT building, list_sort(list(DISTINCT side)) AS sides FROM {_FACES} GROUP BY building) s ON f.building = s.building)) GROUP BY building, shell""")
def shell_components(spark, sf_dir):
    f = _faces(spark, sf_dir)
    s = surfaces.distinct_surfaces(f, "building", "line")
    return surfaces.components(surfaces.edges(s, "building", "side"), "building", "side", surfaces.edge_bounds(f, "building")).groupBy("building", "shell").agg(F.count("*").alias("n"))


#: The middle of each building's box, and where its faces lie on each axis, in half units.
_MIDDLES = f"(SELECT building, min(CASE side WHEN 5 THEN 2 ELSE 0 END) + max(CASE side WHEN 4 THEN 0 ELSE 2 END) AS mx, min(CASE side WHEN 3 THEN 2 ELSE 0 END) + max(CASE side WHEN 2 THEN 0 ELSE 2 END) AS my, min(CASE side WHEN 1 THEN 2 ELSE 0 END) + max(CASE side WHEN 0 THEN 0 ELSE 2 END) AS mz FROM {_FACES} GROUP BY building)"


@query(f"""SELECT building, line, CASE WHEN away=0 THEN false ELSE (line%2=0) <> (away<0) END AS turned FROM (SELECT f.building, f.line, CASE side WHEN 0 THEN mz WHEN 1 THEN 4-mz WHEN 2 THEN my WHEN 3 THEN 4-my WHEN 4 THEN mx ELSE 4-mx END AS away FROM {_FACES} f JOIN {_MIDDLES} m ON f.building=m.building)""")
def orient_outward(spark, sf_dir):
    return surfaces.oriented(_faces(spark, sf_dir), "building").select("building", "line", "turned")


@query(f"SELECT building, line FROM {_FACES} f WHERE NOT EXISTS (SELECT 1 FROM {_FACES} j WHERE j.building=f.building AND j.side=f.side AND j.line%3=0)")
def missing_faces_anti(spark, sf_dir):
    keyed = _faces(spark, sf_dir).withColumn("key", g.surface_form(F.col("outer"), F.col("inners")))
    return surfaces.missing(keyed, keyed.where("line % 3 = 0"), "building", "key").select("building", "line")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before""")
def selection_changes(spark, sf_dir):
    from ..streaming.selection import changes

    return changes(table(spark, sf_dir, "events"), ("user_id",), "event_type", "event_id").select("user_id", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, value > 50 AS flag, lag(value > 50) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE flag AND NOT COALESCE(before, false)""")
def open_map_edges(spark, sf_dir):
    from ..streaming.selection import rising

    return rising(table(spark, sf_dir, "events").withColumn("flag", F.coalesce(F.col("value") > 50, F.lit(False))), ("user_id",), "flag", "event_id").select("user_id", "event_id")


@query("""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sec, event_id) AS n FROM (SELECT user_id||'-'||event_type AS key, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id%7=0 AS failed FROM events)),
 f AS (SELECT key, event_id, n, CASE WHEN failed THEN 'error' ELSE 'store' END AS answer, CASE WHEN NOT failed THEN sec END AS stored FROM r WHERE n=1
 UNION ALL SELECT r.key, r.event_id, r.n, CASE WHEN r.sec-f.stored <= 43200 THEN 'hit' WHEN NOT r.failed THEN 'store' WHEN r.sec-f.stored <= 324000 THEN 'stale' ELSE 'error' END, CASE WHEN r.sec-f.stored <= 43200 OR r.failed THEN f.stored ELSE r.sec END FROM f JOIN r ON r.key=f.key AND r.n=f.n+1)
 SELECT key, event_id, answer FROM f""")
def ttl_cache_hits(spark, sf_dir):
    from ..streaming.selection import cache_answers

    e = table(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 7 == 0).alias("failed"))
    return cache_answers(e, 12 * 3600, 90 * 3600)


@query("SELECT c_mktsegment AS layer, count(*) AS features, CASE WHEN count(*)=0 THEN 'warning' WHEN max(c_nationkey%5)=4 AND min(c_nationkey)=0 THEN 'remark' ELSE 'ok' END AS level FROM customer GROUP BY c_mktsegment")
def diag_wfs_status(spark, sf_dir):
    from ..operators.diagnostics import status

    c = table(spark, sf_dir, "customer")
    s = status(c.withColumn("cached", F.col("c_nationkey") % 5 == 4).groupBy(F.col("c_mktsegment").alias("layer")).agg(F.count("*").alias("features"), (F.max("cached") & (F.min("c_nationkey") == 0)).alias("cached")))
    return s.select("layer", "features", "level")


@query("SELECT p_partkey, (['image/png','image/jpeg','IMAGE/TIFF','text/plain'])[p_partkey%4+1] AS mime, (['.png','.jpg','.tif','.bin'])[p_partkey%4+1] AS ext, CASE WHEN p_size*100>=1024 THEN (p_size*100//1024)||' KB' ELSE (p_size*100)||' B' END AS size, CASE WHEN p_size=1 THEN '1 layer' ELSE p_size||' layers' END AS label FROM part")
def text_labels(spark, sf_dir):
    mime = F.element_at(F.array(*map(F.lit, ("image/png", "image/jpeg", "IMAGE/TIFF", "text/plain"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", mime.alias("mime"), text.extension_of(mime).alias("ext"), text.size_label(F.col("p_size").cast("long") * 100).alias("size"), text.plural(F.col("p_size"), "layer").alias("label"))


@query("SELECT n_nationkey, 'v '||n_nationkey AS a, 'last' AS b, '' AS c FROM nation")
def query_string_parameters(spark, sf_dir):
    m = text.query_parameters(F.concat(F.lit("a=v+"), F.col("n_nationkey").cast("string"), F.lit("&b=first&&c=&b=%6Cast")))
    return table(spark, sf_dir, "nation").select("n_nationkey", *(F.element_at(m, F.lit(k)).alias(k) for k in "abc"))
