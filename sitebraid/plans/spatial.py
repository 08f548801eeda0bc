"""Queries over systems, contexts, requests and catalogs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import requests, srs, text
from ..operators import catalog, context
from .derived import CATALOG, LAT, LON, POINTS, boxes, boxes_sql, d, points, table
from .derived import catalog as layers_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NAMES = "['urn:ogc:def:crs:EPSG::25832','epsg:25833','EPSG:27700',' web 3857 ','EPSG:7844','crs84/4283','EPSG:4326','7423','  odd one ','', 'EPSG:31467','x25833y25832']"
_NAME_LIST = ["urn:ogc:def:crs:EPSG::25832", "epsg:25833", "EPSG:27700", " web 3857 ", "EPSG:7844", "crs84/4283", "EPSG:4326", "7423", "  odd one ", "", "EPSG:31467", "x25833y25832"]


def _case(x: str, other: str) -> str:
    return f"CASE WHEN trim({x})='' THEN '' " + " ".join(f"WHEN contains({x},'{c}') THEN 'EPSG:{c}'" for c in srs.CODES) + f" ELSE {other} END"


def _rank(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x}='EPSG:{c}' THEN {r}" for c, r in srs.RANKS.items()) + " ELSE 0 END"


@query(f"SELECT p_partkey, {_case('s', 'upper(trim(s))')} AS upper_srs, {_case('s', 'trim(s)')} AS trim_srs, {_case('s', chr(39) * 2)} AS empty_srs FROM (SELECT p_partkey, ({_NAMES})[p_partkey%12+1] AS s FROM part)")
def srs_normalize(spark, sf_dir):
    s = F.element_at(F.array(*map(F.lit, _NAME_LIST)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", *(srs.normalize(s, m).alias(f"{m}_srs") for m in ("upper", "trim", "empty")))


@query(f"""SELECT p_brand, srs, rank FROM (SELECT p_brand, srs, {_rank('srs')} AS rank, row_number() OVER (PARTITION BY p_brand ORDER BY {_rank('srs')} DESC, p_partkey) AS n
 FROM (SELECT p_brand, p_partkey, {_case('s', 'upper(trim(s))')} AS srs FROM (SELECT p_brand, p_partkey, ({_NAMES})[(p_partkey*7)%12+1] AS s FROM part))) WHERE n=1""")
def srs_best_rank(spark, sf_dir):
    s = F.element_at(F.array(*map(F.lit, _NAME_LIST)), (F.col("p_partkey") * 7 % 12 + 1).cast("int"))
    return catalog.best_srs(table(spark, sf_dir, "part").withColumn("s", s), ("p_brand",), "s", "p_partkey")


def _utm_sql(lon: str, lat: str, zone: int) -> tuple[str, str]:
    """The projection's series once more, in SQL, for the other engine."""
    import math

    f = srs.FLATTENING
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    c = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    phi = f"({lat} * {c(math.pi / 180)})"
    n = f"({c(srs.AXIS)} / sqrt({c(1.0)} - {c(e2)} * sin({phi}) * sin({phi})))"
    t, cc = f"(tan({phi}) * tan({phi}))", f"({c(ep2)} * cos({phi}) * cos({phi}))"
    a = f"(({lon} - {c(6.0 * zone - 183.0)}) * {c(math.pi / 180)} * cos({phi}))"
    m = f"({c(srs.AXIS)} * ({c(1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)} * {phi} - {c(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024)} * sin({c(2.0)} * {phi}) + {c(15 * e2**2 / 256 + 45 * e2**3 / 1024)} * sin({c(4.0)} * {phi}) - {c(35 * e2**3 / 3072)} * sin({c(6.0)} * {phi})))"
    a2 = f"({a} * {a})"
    x = f"({c(srs.SCALE)} * {n} * ({a} + ({c(1.0)} - {t} + {cc}) * {a2} * {a} / {c(6.0)} + ({c(5.0)} - {c(18.0)} * {t} + {t} * {t} + {c(72.0)} * {cc} - {c(58 * ep2)}) * {a2} * {a2} * {a} / {c(120.0)}) + {c(srs.EASTING)})"
    y = f"({c(srs.SCALE)} * ({m} + {n} * tan({phi}) * ({a2} / {c(2.0)} + ({c(5.0)} - {t} + {c(9.0)} * {cc} + {c(4.0)} * {cc} * {cc}) * {a2} * {a2} / {c(24.0)} + ({c(61.0)} - {c(58.0)} * {t} + {t} * {t} + {c(600.0)} * {cc} - {c(330 * ep2)}) * {a2} * {a2} * {a2} / {c(720.0)})))"
    return x, y


def _mm(x: str, scale: str = "1000") -> str:
    return f"CAST(floor({x} * CAST({scale} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)"


_X32, _Y32 = _utm_sql("lon", "lat", 32)
_XM, _YM = "(lon * CAST('111319.49079327358' AS DOUBLE))", "(ln(tan(CAST('0.7853981633974483' AS DOUBLE) + lat * CAST('0.008726646259971648' AS DOUBLE))) * CAST(6378137 AS DOUBLE))"


@query(f"SELECT id, {_mm(_X32)} AS x_mm, {_mm(_Y32)} AS y_mm FROM {POINTS}")
def crs_to_utm32(spark, sf_dir):
    p = srs.transform_xy("EPSG:4326", "EPSG:25832", F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("id", srs.whole(p["x"]).alias("x_mm"), srs.whole(p["y"]).alias("y_mm"))


@query(f"SELECT id, {_mm(_XM)} AS x_mm, {_mm(_YM)} AS y_mm FROM {POINTS}")
def crs_to_webmercator(spark, sf_dir):
    p = srs.transform_xy("EPSG:4326", "EPSG:3857", F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("id", srs.whole(p["x"]).alias("x_mm"), srs.whole(p["y"]).alias("y_mm"))


@query(f"SELECT id, {_mm('lon', '1e7')} AS same_x, true AS no_27700, {_mm('lat', '1e7')} AS back_y FROM {POINTS}")
def crs_identity_or_null(spark, sf_dir):
    same = srs.transform_xy("EPSG:7423", "EPSG:7423", F.col("lon"), F.col("lat"))
    none = srs.transform_xy("EPSG:4326", "EPSG:27700", F.col("lon"), F.col("lat"))
    p = srs.transform_xy("EPSG:4326", "EPSG:25832", F.col("lon"), F.col("lat"))
    back = srs.transform_xy("EPSG:25832", "EPSG:4326", p["x"], p["y"])
    return points(spark, sf_dir).select("id", srs.whole(same["x"], 1e7).alias("same_x"), none.isNull().alias("no_27700"), srs.whole(back["y"], 1e7).alias("back_y"))


def _box32() -> str:
    xs = [_utm_sql(x, y, 32) for x in ("min_x", "max_x") for y in ("min_y", "max_y")]
    return ", ".join(_mm(f"{f}({', '.join(p[i] for p in xs)})") + f" AS {n}" for f, i, n in (("least", 0, "x0"), ("least", 1, "y0"), ("greatest", 0, "x1"), ("greatest", 1, "y1")))


@query(f"SELECT n_nationkey, {_box32()} FROM {boxes_sql('nation', 'n_nationkey', 'n_nationkey')}")
def ctx_build_bboxes_by_srs(spark, sf_dir):
    made = boxes(table(spark, sf_dir, "nation"), "n_nationkey").withColumn("m", context.boxes_by_srs(F.col("box")))
    b = F.element_at("m", F.lit("EPSG:25832"))
    return made.select("n_nationkey", *(srs.whole(b[c]).alias(n) for c, n in (("min_x", "x0"), ("min_y", "y0"), ("max_x", "x1"), ("max_y", "y1"))))


@query(f"""SELECT n_nationkey, CASE wanted WHEN 'EPSG:4326' THEN {_mm('min_x', '1e7')} WHEN 'EPSG:7423' THEN {_mm('min_x', '1e7')} WHEN 'EPSG:4283' THEN {_mm('(min_x - 1)', '1e7')} WHEN 'EPSG:27700' THEN {_mm('(min_x + 1)', '1e7')} ELSE NULL END AS min_x7, wanted
 FROM (SELECT *, (['EPSG:4326','EPSG:7423','EPSG:4283','EPSG:27700','EPSG:99999'])[n_nationkey%5+1] AS wanted FROM {boxes_sql('nation', 'n_nationkey', 'n_nationkey')})""")
def ctx_bbox_lookup(spark, sf_dir):
    moved = lambda by: F.struct((F.col("box.min_x") + by).alias("min_x"), F.col("box.min_y"), F.col("box.max_x"), F.col("box.max_y"))
    wanted = F.element_at(F.array(*map(F.lit, ("EPSG:4326", "EPSG:7423", "EPSG:4283", "EPSG:27700", "EPSG:99999"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    n = boxes(table(spark, sf_dir, "nation"), "n_nationkey").withColumn("wanted", wanted)
    found = context.box_for(F.create_map(F.lit("EPSG:4326"), F.col("box")), F.col("wanted"), F.lit("EPSG:27700"), moved(d(1.0)), moved(d(-1.0)))
    return n.select("n_nationkey", srs.whole(found["min_x"], 1e7).alias("min_x7"), "wanted")


@query(f"SELECT n_nationkey, {_mm('min_x', '1e7')} AS request_x7, true AS parsed, n_nationkey % 2 = 0 AS absolute, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE {_mm('min_y', '1e7')} END AS origin_y7, 1 AS n_boxes FROM {boxes_sql('nation', 'n_nationkey', 'n_nationkey')}")
def ctx_json_round_trip(spark, sf_dir):
    absolute = F.col("n_nationkey") % 2 == 0
    j = context.to_json(F.lit("EPSG:4326"), F.col("box"), F.col("box"), absolute, F.create_map(F.lit("EPSG:4326"), F.col("box")))
    c = boxes(table(spark, sf_dir, "nation"), "n_nationkey").select("n_nationkey", context.from_json(j).alias("c"))
    return c.select("n_nationkey", srs.whole(F.col("c.requestBoundingBox.minX"), 1e7).alias("request_x7"), F.col("c").isNotNull().alias("parsed"), F.col("c.useAbsoluteCoordinates").alias("absolute"), srs.whole(F.col("c.placementOrigin.y"), 1e7).alias("origin_y7"), F.size("c.boundingBoxesBySrs").alias("n_boxes"))


@query(f"SELECT nation, {_mm('min(lon)', '1e7')} AS x7, {_mm('min(lat)', '1e7')} AS y7, count(*) AS n FROM {POINTS} GROUP BY nation")
def wfs_localize_offset(spark, sf_dir):
    p = context.localising_offset(points(spark, sf_dir), ("nation",), "lon", "lat")
    return p.select("nation", srs.whole(F.col("offset_x"), 1e7).alias("x7"), srs.whole(F.col("offset_y"), 1e7).alias("y7"), F.col("points").alias("n"))


@query("""SELECT o_orderkey, layer_index, feature_index FROM (SELECT o_orderkey, layer_index, row_number() OVER (PARTITION BY layer_index ORDER BY o_orderkey) - 1 AS feature_index
 FROM orders JOIN (SELECT * FROM (VALUES (0,'5-LOW'),(1,'1-URGENT'),(2,'nothing'),(3,'3-MEDIUM')) t(layer_index, name)) l ON upper(o_orderpriority) = upper(name))""")
def wfs_tree_paths(spark, sf_dir):
    layers = spark.createDataFrame([(0, "5-low"), (1, "1-Urgent"), (2, "nothing"), (3, "3-MEDIUM")], "layer_index int, name string")
    return context.tree_paths(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.broadcast(layers), "o_orderpriority", "o_orderkey").select("o_orderkey", "layer_index", "feature_index")


@query(f"SELECT seq, CASE WHEN trim(title)='' THEN name||' | '||name ELSE name||' | '||title END AS label, trim(split_part(name||' | '||title,'|',1)) AS parsed FROM {CATALOG} WHERE name<>' '")
def layer_labels(spark, sf_dir):
    c = layers_of(spark, sf_dir).where("name <> ' '")
    label = text.layer_label(F.col("name"), F.col("title"))
    return c.select("seq", label.alias("label"), text.layer_name(label).alias("parsed"))


@query(f"""SELECT service, name, row_number() OVER (PARTITION BY service ORDER BY seq) - 1 AS layer_index FROM (SELECT service, seq, name, row_number() OVER (PARTITION BY service, upper(name) ORDER BY seq) AS n
 FROM {CATALOG} WHERE trim(name)<>'') WHERE n=1""")
def wfs_layer_request_dedup(spark, sf_dir):
    c = layers_of(spark, sf_dir).withColumn("label", F.concat_ws(" | ", "name", "title"))
    return catalog.requested_layers(c, "label", "seq", ("service",)).select("service", "name", "layer_index")


@query(f"SELECT seq, name, title FROM (SELECT *, row_number() OVER (PARTITION BY upper(name) ORDER BY seq) AS n FROM {CATALOG} WHERE trim(name)<>'') WHERE n=1 ORDER BY upper(name), seq")
def catalog_dedup_sort(spark, sf_dir):
    return catalog.in_order(catalog.distinct_first(layers_of(spark, sf_dir), "name", "seq"), "name", "seq").select("seq", "name", "title")


def _score(scores: tuple) -> str:
    return " + ".join(f"CASE WHEN {' OR '.join(f'contains(lower(x), {w!r})' for w in words)} THEN {p} ELSE 0 END" for words, p in scores)


def _best(scores: tuple) -> str:
    return f"SELECT service, name, score FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY score DESC, upper(name), name) AS n FROM (SELECT service, name, {_score(scores)} AS score FROM (SELECT *, name||' '||title AS x FROM {CATALOG}))) WHERE n=1"


@query(_best(catalog.IMAGERY_SCORES))
def wms_layer_top1(spark, sf_dir):
    return catalog.best_layer(layers_of(spark, sf_dir), ("service",), "name", "title", catalog.IMAGERY_SCORES)


@query(_best(catalog.BUILDING_SCORES))
def lod2_layer_top1(spark, sf_dir):
    return catalog.best_layer(layers_of(spark, sf_dir), ("service",), "name", "title", catalog.BUILDING_SCORES)


@query("""SELECT 'n'||n_nationkey AS node_id, n_name AS name, CASE WHEN n_nationkey%3=0 THEN 'EPSG:4326,EPSG:3857' WHEN n_regionkey = n_nationkey%5 THEN 'EPSG:4326,R'||n_regionkey ELSE 'EPSG:4326,R'||n_regionkey||',N'||(n_nationkey%5) END AS srs FROM nation WHERE n_nationkey%3<>0
 UNION ALL SELECT 'n'||n_nationkey, n_name, 'EPSG:4326,R'||n_regionkey FROM nation WHERE n_nationkey%3=0 UNION ALL SELECT 'r'||r_regionkey, r_name, 'EPSG:4326,R'||r_regionkey FROM region UNION ALL SELECT 'root', NULL, 'EPSG:4326'""".replace("WHEN n_regionkey = n_nationkey%5 THEN 'EPSG:4326,R'||n_regionkey ", ""))
def wms_layer_tree_inherit(spark, sf_dir):
    root = spark.createDataFrame([("root", None, None, ["EPSG:4326"])], "node_id string, parent_id string, name string, srs array<string>")
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("name"), F.array(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")), F.lit("EPSG:4326")).alias("srs"))
    k = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("node_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_name").alias("name"), F.when(k % 3 != 0, F.array(F.lit("EPSG:4326"), F.concat(F.lit("N"), (k % 5).cast("string")))).alias("srs"))
    return catalog.inherited(root.unionByName(region).unionByName(nation)).select("node_id", "name", F.array_join("srs_list", ",").alias("srs"))


_URL = "'http://h'||n_nationkey||'.example/ows?'||(['service=WFS&map=a%20b','MAP=x&Request=GetMap&&key=1','map=only','%53ERVICE=WMS&styles=&token=q','BBOX=1,2&width=3&crs=4'])[n_nationkey%5+1]"


def _url():
    k = F.col("n_nationkey")
    q = F.element_at(F.array(*map(F.lit, ("service=WFS&map=a%20b", "MAP=x&Request=GetMap&&key=1", "map=only", "%53ERVICE=WMS&styles=&token=q", "BBOX=1,2&width=3&crs=4"))), (k % 5 + 1).cast("int"))
    return F.concat(F.lit("http://h"), k.cast("string"), F.lit(".example/ows?"), q)


def _base_sql(service: str) -> str:
    keys = ",".join(f"'{k}'" for k in requests.RESERVED[service])
    kept = f"list_filter(string_split(split_part({_URL},'?',2),'&'), lambda p: p<>'' AND NOT list_contains([{keys}], upper(url_decode(split_part(p,'=',1)))))"
    return f"(CASE WHEN len({kept})>0 THEN split_part({_URL},'?',1)||'?'||array_to_string({kept},'&') ELSE split_part({_URL},'?',1) END)"


@query(f"SELECT n_nationkey, {_base_sql('wfs')} AS wfs, {_base_sql('wms')} AS wms, {_base_sql('wcs')} AS wcs FROM nation")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", *(requests.base_url(_url(), s).alias(s) for s in ("wfs", "wms", "wcs")))


def _start_sql(service: str) -> str:
    b = _base_sql(service)
    return f"{b}||CASE WHEN contains({b},'?') THEN '&' ELSE '?' END"


_CELL = "(SELECT *, CAST(n_nationkey AS DOUBLE) AS min_x, CAST(n_nationkey*2 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS min_y, CAST(n_nationkey AS DOUBLE)+CAST(1.25 AS DOUBLE) AS max_x, CAST(n_nationkey*2+3 AS DOUBLE) AS max_y FROM nation)"
_CELL_TEXT = "n_nationkey||','||(n_nationkey*2)||'.5,'||(n_nationkey+1)||'.25,'||(n_nationkey*2+3)"


def _cell(df):
    k = F.col("n_nationkey").cast("double")
    return df.withColumn("box", F.struct(k.alias("min_x"), (k * 2 + 0.5).alias("min_y"), (k + 1.25).alias("max_x"), (k * 2 + 3).alias("max_y")))


@query(f"""SELECT n_nationkey, {_start_sql('wfs')}||'SERVICE=WFS&VERSION='||CASE WHEN n_nationkey%2=0 THEN '2.0.0' ELSE '1.1.0' END||'&REQUEST=GetFeature'||CASE WHEN n_nationkey%2=0 THEN '&TYPENAMES=' ELSE '&TYPENAME=' END||'ns%3A'||replace(n_name,' ','%20')
 ||CASE WHEN n_nationkey%3=0 THEN '' ELSE '&SRSNAME=EPSG%3A25832' END||CASE WHEN n_nationkey%4>0 THEN '&MAXFEATURES='||(n_nationkey%4)||'&COUNT='||(n_nationkey%4) ELSE '' END||'&OUTPUTFORMAT=application%2Fjson&BBOX='||{_CELL_TEXT}||CASE WHEN n_nationkey%3=0 THEN '' ELSE ',EPSG%3A25832' END AS url FROM nation""")
def url_getfeature(spark, sf_dir):
    k = F.col("n_nationkey")
    n = _cell(table(spark, sf_dir, "nation"))
    u = requests.get_feature(_url(), F.when(k % 2 == 0, "2.0.0").otherwise("1.1.0"), F.concat(F.lit("ns:"), F.col("n_name")), F.when(k % 3 != 0, "EPSG:25832"), k % 4, F.lit("application/json"), F.col("box"))
    return n.select("n_nationkey", u.alias("url"))


@query(f"""SELECT n_nationkey, {_start_sql('wms')}||'SERVICE=WMS&VERSION='||CASE WHEN n_nationkey%2=0 THEN '1.3.0' ELSE '1.1.1' END||'&REQUEST=GetMap&LAYERS='||replace(n_name,' ','%20')||'&STYLES='||CASE WHEN n_nationkey%2=0 THEN '&CRS=' ELSE '&SRS=' END||'EPSG%3A3857&BBOX='||{_CELL_TEXT}||'&WIDTH='||(n_nationkey+100)||'&HEIGHT=200&FORMAT=image%2Fpng&TRANSPARENT='||CASE WHEN n_nationkey%3=0 THEN 'TRUE' ELSE 'FALSE' END AS url FROM nation""")
def url_getmap(spark, sf_dir):
    k = F.col("n_nationkey")
    u = requests.get_map(_url(), F.when(k % 2 == 0, "1.3.0").otherwise("1.1.1"), F.col("n_name"), F.lit("EPSG:3857"), F.col("box"), k + 100, F.lit(200), F.lit("image/png"), k % 3 == 0)
    return _cell(table(spark, sf_dir, "nation")).select("n_nationkey", u.alias("url"))


@query(f"""SELECT n_nationkey, {_start_sql('wcs')}||'SERVICE=WCS&REQUEST=GetCoverage&VERSION=2.0.1&COVERAGEID=dem__'||n_nationkey||'&FORMAT=image%2Ftiff&SUBSET='||CASE WHEN n_nationkey%2=0 THEN 'E' ELSE 'x' END||'('||n_nationkey||','||(n_nationkey+1)||'.25)&SUBSET=N('||(n_nationkey*2)||'.5,'||(n_nationkey*2+3)||')&SUBSETTINGCRS=EPSG%3A25832&OUTPUTCRS=EPSG%3A25832' AS url,
 {_start_sql('wcs')}||'SERVICE=WCS&REQUEST=DescribeCoverage&VERSION=2.0.1&COVERAGEID=dem__'||n_nationkey AS describe, {_start_sql('wfs')}||'SERVICE=WFS&VERSION=2.0.0&REQUEST=GetCapabilities' AS capabilities FROM nation""")
def url_getcoverage(spark, sf_dir):
    k = F.col("n_nationkey")
    name = F.concat(F.lit("dem__"), k.cast("string"))
    u = requests.get_coverage(_url(), F.lit("2.0.1"), name, F.lit("EPSG:25832"), F.col("box"), F.lit("image/tiff"), F.when(k % 2 == 0, "E").otherwise(" "), F.lit("N"))
    return _cell(table(spark, sf_dir, "nation")).select("n_nationkey", u.alias("url"), requests.describe_coverage(_url(), F.lit("2.0.1"), name).alias("describe"), requests.get_capabilities(_url(), "wfs", F.lit("2.0.0")).alias("capabilities"))


@query(f"SELECT n_nationkey, {_CELL_TEXT} AS bbox, sha256({_CELL_TEXT}) AS key, true AS parsed FROM nation")
def bbox_format_cachekey(spark, sf_dir):
    t = text.bbox_text(F.col("box"))
    return _cell(table(spark, sf_dir, "nation")).select("n_nationkey", t.alias("bbox"), F.sha2(t, 256).alias("key"), text.bbox_parse(t).isNotNull().alias("parsed"))


_W = "CASE WHEN s_suppkey%3=0 THEN 6144 ELSE least(CAST(500+s_suppkey*37 AS INTEGER),6144) END"
_H = "CASE WHEN s_suppkey%4=0 THEN 6144 ELSE least(CAST(300+s_suppkey*91 AS INTEGER),6144) END"
_IMAGE = f"""(SELECT s_suppkey, CASE WHEN px > 24000000 THEN greatest(1, CAST(round_even(w1*sqrt(24000000.0::DOUBLE/px),0) AS INTEGER)) ELSE w1 END AS width, CASE WHEN px > 24000000 THEN greatest(1, CAST(round_even(h1*sqrt(24000000.0::DOUBLE/px),0) AS INTEGER)) ELSE h1 END AS height FROM (
 SELECT *, CAST(w1 AS DOUBLE)*h1 AS px FROM (SELECT s_suppkey, CASE WHEN a>=1 THEN CASE WHEN wh>h THEN greatest(1,CAST(round_even(w*(CAST(h AS DOUBLE)/wh),0) AS INTEGER)) ELSE w END ELSE CASE WHEN tw>w THEN w ELSE tw END END AS w1,
 CASE WHEN a>=1 THEN CASE WHEN wh>h THEN h ELSE wh END ELSE CASE WHEN tw>w THEN greatest(1,CAST(round_even(h*(CAST(w AS DOUBLE)/tw),0) AS INTEGER)) ELSE h END END AS h1 FROM (
 SELECT *, greatest(1,CAST(round_even(w/a,0) AS INTEGER)) AS wh, greatest(1,CAST(round_even(h*a,0) AS INTEGER)) AS tw FROM (SELECT s_suppkey, {_W} AS w, {_H} AS h, CAST(s_suppkey%13+1 AS DOUBLE)/CAST(s_suppkey%7+1 AS DOUBLE) AS a FROM supplier)))))"""


@query(f"SELECT s_suppkey, width, height FROM {_IMAGE}")
def wms_image_size(spark, sf_dir):
    k = F.col("s_suppkey")
    b = F.struct(d(0.0).alias("min_x"), d(0.0).alias("min_y"), (k % 13 + 1).cast("double").alias("max_x"), (k % 7 + 1).cast("double").alias("max_y"))
    size = requests.image_size(b, F.when(k % 3 == 0, F.lit(None)).otherwise(k * 37 + 500), F.when(k % 4 == 0, F.lit(0)).otherwise(k * 91 + 300))
    return table(spark, sf_dir, "supplier").select("s_suppkey", size.alias("s")).select("s_suppkey", "s.width", "s.height")


@query("""SELECT s_suppkey, CASE WHEN w2>=w AND h2>=h THEN NULL ELSE w2 END AS width, CASE WHEN w2>=w AND h2>=h THEN NULL ELSE h2 END AS height FROM (SELECT *, greatest(512,CAST(floor(w*CAST(0.85 AS DOUBLE)) AS INTEGER)) AS w2, greatest(512,CAST(floor(h*CAST(0.85 AS DOUBLE)) AS INTEGER)) AS h2
 FROM (SELECT s_suppkey, CAST(s_suppkey%40*100+100 AS INTEGER) AS w, CAST(s_suppkey%23*90+200 AS INTEGER) AS h FROM supplier))""")
def wms_reduce_size(spark, sf_dir):
    k = F.col("s_suppkey")
    s = requests.reduced((k % 40 * 100 + 100).cast("int"), (k % 23 * 90 + 200).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", s.alias("s")).select("s_suppkey", "s.width", "s.height")
