"""Geometry, tags, catalogs and rasters derived from the plain tables by integer rules, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over as many tasks as shuffles have: a file of few bytes is read in one, however long each of its rows then takes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def d(x: float) -> Column:
    return F.lit(float(x))


def lon_lat(key: Column) -> tuple[Column, Column]:
    """Degrees of a point inside UTM zone 32, from a key."""
    return d(8.4) + (key * 37 % 1000).cast("double") * d(0.0004), d(50.0) + (key * 61 % 1000).cast("double") * d(0.0002)


#: The same in SQL for the other engine; {k} is the key.
LON = "(CAST(8.4 AS DOUBLE) + CAST({k}*37 % 1000 AS DOUBLE) * CAST(0.0004 AS DOUBLE))"
LAT = "(CAST(50.0 AS DOUBLE) + CAST({k}*61 % 1000 AS DOUBLE) * CAST(0.0002 AS DOUBLE))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point a customer: id, nation, lon, lat."""
    lon, lat = lon_lat(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), lon.alias("lon"), lat.alias("lat"))


POINTS = f"(SELECT c_custkey AS id, c_nationkey AS nation, {LON.format(k='c_custkey')} AS lon, {LAT.format(k='c_custkey')} AS lat FROM customer)"


def boxes(df: DataFrame, key: str) -> DataFrame:
    """df with box: a rectangle in degrees around the key's point, half of it 0.0001 (1 + key % 5)."""
    lon, lat = lon_lat(F.col(key))
    half = (F.col(key) % 5 + 1).cast("double") * d(0.0001)
    return df.withColumn("box", F.struct((lon - half).alias("min_x"), (lat - half).alias("min_y"), (lon + half).alias("max_x"), (lat + half).alias("max_y")))


def boxes_sql(source: str, key: str, keep: str) -> str:
    half = f"CAST({key} % 5 + 1 AS DOUBLE) * CAST(0.0001 AS DOUBLE)"
    lon, lat = LON.format(k=key), LAT.format(k=key)
    return f"(SELECT {keep}, {lon} - {half} AS min_x, {lat} - {half} AS min_y, {lon} + {half} AS max_x, {lat} + {half} AS max_y FROM {source})"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element an event: id, seq, k, tags, area, line."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id"), "event_type", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k"))
    t, k = F.col("event_type"), F.col("k")
    ks = k.cast("string")
    none = F.expr("cast(map() as map<string,string>)")
    tags = (
        F.when(t == "signup", F.create_map(F.lit("building"), F.when(k % 9 == 0, " ").otherwise("yes"), F.lit("building:levels"), ks, F.lit("height"), F.when(k % 4 == 0, F.concat(ks, F.lit(" ft"))).when(k % 4 == 1, F.concat(ks, F.lit(",5"))).when(k % 4 == 2, "tall").otherwise(F.concat(ks, F.lit("'")))))
        .when(t == "purchase", F.create_map(F.lit("highway"), F.element_at(F.array(*map(F.lit, ("motorway", "primary", "residential", "footway", "service", "tertiary_link"))), (k % 6 + 1).cast("int")), F.lit("lanes"), F.when(k % 3 == 0, ks).otherwise(F.lit("x")), F.lit("width"), F.when(k % 5 == 0, F.concat(ks, F.lit(" m"))).otherwise(F.lit(""))))
        .when(t == "view", F.create_map(F.lit("natural"), F.element_at(F.array(*map(F.lit, ("water", "wood", "Water", "scrub"))), (k % 4 + 1).cast("int")), F.lit("tunnel"), F.when(k % 7 == 0, "culvert").when(k % 7 == 1, "no").otherwise(F.lit("")), F.lit("intermittent"), F.when(k % 11 == 0, "Yes").otherwise("no")))
        .when(t == "click", F.create_map(F.lit("railway"), F.element_at(F.array(*map(F.lit, ("rail", "subway", "tram", "abandoned"))), (k % 4 + 1).cast("int")), F.lit("covered"), F.when(k % 6 == 0, "yes").otherwise("no"), F.lit("leisure"), F.when(k % 3 == 0, "park").otherwise("pitch")))
        .otherwise(none)
    )
    return e.withColumn("tags", tags).withColumn("area", k % 5 != 0).withColumn("line", k % 5 != 1)


#: The same tags in SQL, a column each ('' and NULL where the tag is absent or empty).
TAGGED = """(SELECT event_id AS id, user_id, event_type AS t, k, k % 5 <> 0 AS area, k % 5 <> 1 AS line,
  CASE WHEN event_type='signup' THEN CASE WHEN k%9=0 THEN ' ' ELSE 'yes' END END AS building,
  CASE WHEN event_type='signup' THEN CAST(k AS VARCHAR) END AS levels,
  CASE WHEN event_type='signup' THEN CASE k%4 WHEN 0 THEN k||' ft' WHEN 1 THEN k||',5' WHEN 2 THEN 'tall' ELSE k||'''' END END AS height,
  CASE WHEN event_type='purchase' THEN (['motorway','primary','residential','footway','service','tertiary_link'])[k%6+1] END AS highway,
  CASE WHEN event_type='purchase' THEN CASE WHEN k%3=0 THEN CAST(k AS VARCHAR) ELSE 'x' END END AS lanes,
  CASE WHEN event_type='purchase' THEN CASE WHEN k%5=0 THEN k||' m' ELSE '' END END AS width,
  CASE WHEN event_type='view' THEN (['water','wood','Water','scrub'])[k%4+1] END AS natural_,
  CASE WHEN event_type='view' THEN CASE WHEN k%7=0 THEN 'culvert' WHEN k%7=1 THEN 'no' ELSE '' END END AS tunnel,
  CASE WHEN event_type='view' THEN CASE WHEN k%11=0 THEN 'Yes' ELSE 'no' END END AS intermittent,
  CASE WHEN event_type='click' THEN (['rail','subway','tram','abandoned'])[k%4+1] END AS railway,
  CASE WHEN event_type='click' THEN CASE WHEN k%6=0 THEN 'yes' ELSE 'no' END END AS covered,
  CASE WHEN event_type='click' THEN CASE WHEN k%3=0 THEN 'park' ELSE 'pitch' END END AS leisure
  FROM (SELECT *, COALESCE(CAST(json_extract_string(props,'$.k') AS INTEGER),0) AS k FROM events))"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer a part: seq, service (the part's size), name, title; names repeat in different case, some are blank."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when(k % 17 == 0, F.lit(" ")).when(k % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand"))
    word = F.element_at(F.array(*map(F.lit, ("dop20 rgb", "Ortho image", "cir info", "tk25", "Building LoD2", "bu-core3d", "alkis", "plain"))), (k % 8 + 1).cast("int"))
    return p.select(k.alias("seq"), (F.col("p_size") % 7).alias("service"), name.alias("name"), F.concat_ws(" ", word, "p_type").alias("title"))


CATALOG = """(SELECT p_partkey AS seq, p_size % 7 AS service,
  CASE WHEN p_partkey%17=0 THEN ' ' WHEN p_partkey%2=0 THEN upper(p_brand) ELSE lower(p_brand) END AS name,
  (['dop20 rgb','Ortho image','cir info','tk25','Building LoD2','bu-core3d','alkis','plain'])[p_partkey%8+1] || ' ' || p_type AS title FROM part)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a raster a supplier, of 40 + 10 (r % 4) columns and 30 + 5 (r % 4) rows; every 37th cell is nodata (-9999)."""
    r, kind = F.col("raster_id"), F.col("raster_id") % 4
    rasters = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") - 1).cast("int").alias("raster_id"), F.col("s_nationkey").cast("int").alias("nation"))
    rasters = spread(rasters).select(r, (kind * 10 + 40).alias("width"), (kind * 5 + 30).alias("height"), "nation")
    cells = rasters.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    n = F.col("row") * F.col("width") + F.col("col")
    z = F.when(n % 37 == 0, d(-9999.0)).otherwise((F.col("row") * 7 + F.col("col") * 3 + r * 11 + F.col("nation") * 5).cast("double") % d(101.0) + d(100.0))
    return cells.withColumn("z", z).drop("nation")


GRID = """(SELECT r AS raster_id, w AS width, h AS height, y AS "row", x AS col,
  CASE WHEN (y*w+x) % 37 = 0 THEN CAST(-9999 AS DOUBLE) ELSE CAST((y*7+x*3+r*11+nation*5) % 101 AS DOUBLE) + CAST(100 AS DOUBLE) END AS z
  FROM (SELECT *, unnest(range(0, w)) AS x FROM (SELECT *, unnest(range(0, h)) AS y FROM (SELECT CAST(s_suppkey-1 AS INTEGER) AS r, s_nationkey AS nation, CAST(40+10*((s_suppkey-1)%4) AS INTEGER) AS w, CAST(30+5*((s_suppkey-1)%4) AS INTEGER) AS h FROM supplier))))"""
