"""The site context: one study box in every system, the origin that results are placed at, and its JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import srs

BOX = "struct<minX:double,minY:double,maxX:double,maxY:double>"
SCHEMA = f"resolvedSrs string, requestBoundingBox {BOX}, placementBoundingBox {BOX}, boundingBox4326 {BOX}, placementOrigin struct<x:double,y:double>, useAbsoluteCoordinates boolean, boundingBoxesBySrs map<string,{BOX}>"


def box_in(box: Column, source: str, target: str) -> Column:
    """The box around a box's four projected corners; null where a system has no projection."""
    ends = [srs.transform_xy(source, target, box[x], box[y]) for x in ("min_x", "max_x") for y in ("min_y", "max_y")]
    xs, ys = [e["x"] for e in ends], [e["y"] for e in ends]
    good = ends[0].isNotNull()
    return F.when(good, F.struct(F.least(*xs).alias("min_x"), F.least(*ys).alias("min_y"), F.greatest(*xs).alias("max_x"), F.greatest(*ys).alias("max_y")))


def boxes_by_srs(box: Column, source: str = "EPSG:4326", targets: tuple[str, ...] = ("EPSG:4326", "EPSG:25832", "EPSG:25833", "EPSG:3857")) -> Column:
    """map of system to the box in it."""
    return F.create_map(*[x for t in targets for x in (F.lit(t), box_in(box, source, t))])


def box_for(boxes: Column, wanted: Column, own: Column, request: Column, wgs84: Column) -> Column:
    """The box for a system: its own entry; for heights-aware 7423 that of 4326; the request's for the context's system; the geographic one for geographic systems."""
    return F.coalesce(F.element_at(boxes, wanted), F.when(wanted == "EPSG:7423", F.element_at(boxes, F.lit("EPSG:4326"))), F.when(wanted == own, request), F.when(srs.is_geographic(wanted), wgs84))


def origin(box: Column, absolute: Column) -> Column:
    """Where results are moved from: the box's lower corner, or zero for absolute coordinates."""
    return F.struct(F.when(absolute, F.lit(0.0)).otherwise(box["min_x"]).alias("x"), F.when(absolute, F.lit(0.0)).otherwise(box["min_y"]).alias("y"))


def placed(box: Column, start: Column) -> Column:
    return F.struct((box["min_x"] - start["x"]).alias("min_x"), (box["min_y"] - start["y"]).alias("min_y"), (box["max_x"] - start["x"]).alias("max_x"), (box["max_y"] - start["y"]).alias("max_y"))


def _camel(box: Column) -> Column:
    return F.when(box.isNotNull(), F.struct(box["min_x"].alias("minX"), box["min_y"].alias("minY"), box["max_x"].alias("maxX"), box["max_y"].alias("maxY")))


def to_json(resolved: Column, request: Column, wgs84: Column, absolute: Column, boxes: Column) -> Column:
    """The context as camelCase JSON; map keys stay as they are."""
    start = origin(request, absolute)
    return F.to_json(F.struct(resolved.alias("resolvedSrs"), _camel(request).alias("requestBoundingBox"), _camel(request).alias("placementBoundingBox"), _camel(wgs84).alias("boundingBox4326"), start.alias("placementOrigin"), absolute.alias("useAbsoluteCoordinates"), F.transform_values(boxes, lambda k, v: _camel(v)).alias("boundingBoxesBySrs")))


def from_json(text: Column) -> Column:
    """The parsed context, null for blank or invalid text or one without a resolved system."""
    parsed = F.from_json(text, SCHEMA)
    return F.when(F.coalesce(F.trim(parsed["resolvedSrs"]) != "", F.lit(False)), parsed)


#: Ranges that a layer's features are numbered in.
RANGES = 64


def tree_paths(features: DataFrame, layers: DataFrame, layer: str, sequence: str) -> DataFrame:
    """Features of the requested layers (layer_index, name; case ignored) with their place in each layer, by a numeric sequence.

    A layer is cut into ranges of the sequence at its quantiles; places are counted in each range and moved by
    the sizes of those before it, so a layer that holds most features is spread over tasks.
    """
    from pyspark.sql import Window as W

    met = features.join(layers.select("layer_index", F.upper("name").alias("_key")), F.upper(F.col(layer)) == F.col("_key")).drop("_key")
    cuts = met.groupBy("layer_index").agg(F.percentile_approx(sequence, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))
    dealt = met.join(F.broadcast(cuts), "layer_index").withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(sequence)))).drop("_cuts")  # a row a layer
    sizes = dealt.groupBy("layer_index", "_range").agg(F.count("*").alias("_n"))
    before = sizes.select("layer_index", "_range", (F.sum("_n").over(W.partitionBy("layer_index").orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("layer_index", "_range").orderBy(sequence)) - 1
    numbered = dealt.withColumn("_place", place).join(F.broadcast(before), ["layer_index", "_range"])  # RANGES rows a layer
    return numbered.withColumn("feature_index", (F.col("_place") + F.col("_before")).cast("int")).drop("_range", "_place", "_before")


def save(contexts: DataFrame, path: str, key: str = "name", text: str = "context") -> None:
    """Keeps named contexts (JSON) as a table."""
    contexts.select(F.col(key).alias("name"), F.col(text).alias("context")).write.mode("overwrite").parquet(path)


def restore(spark, path: str) -> DataFrame:
    """name, context (parsed; null where the kept text is no context) of a table that save wrote."""
    return spark.read.schema("name string, context string").parquet(path).select("name", from_json(F.col("context")).alias("context"))


def localising_offset(points: DataFrame, by: tuple[str, ...], x: str = "x", y: str = "y") -> DataFrame:
    """The lowest x and y of each group, 0 where it has none: what local coordinates are moved by."""
    return points.groupBy(*by).agg(F.coalesce(F.min(x), F.lit(0.0)).alias("offset_x"), F.coalesce(F.min(y), F.lit(0.0)).alias("offset_y"), F.count("*").alias("points"))
