"""Elevation rasters as tables of cells, meshes, samples and baselines.

Raster cells are rows (raster_id, row, col, z): a raster of any size is spread over tasks, and sampling is
an equi join on cell numbers, never a search through a raster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples an axis of a mesh at most; how near to nodata counts as nodata.
MOST_SAMPLES, NEAR_NODATA = 512, 1e-3


def is_nodata(z: Column, nodata: Column) -> Column:
    return F.coalesce(F.abs(z - nodata) < NEAR_NODATA, F.lit(False))


def stride(size: Column, most: int = MOST_SAMPLES) -> Column:
    """The whole step that keeps an axis to most samples."""
    return F.greatest(F.lit(1), F.ceil(size / F.lit(float(most))).cast("int"))


def downsampled(cells: DataFrame, width: str, height: str, most: int = MOST_SAMPLES) -> DataFrame:
    """Cells on the regular grid of strides, with their sample numbers; the last row or column may fall out."""
    sx, sy = stride(F.col(width), most), stride(F.col(height), most)
    kept = cells.where((F.col("col") % sx == 0) & (F.col("row") % sy == 0))
    return kept.withColumn("sample_x", (F.col("col") / sx).cast("int")).withColumn("sample_y", (F.col("row") / sy).cast("int"))


def vertices(cells: DataFrame, box: str, width: str, height: str, nodata: Column, baseline: Column) -> DataFrame:
    """x, y, z of cells: spread over the box, z above the baseline, nodata on it."""
    b = F.col(box)
    x = b["min_x"] + (b["max_x"] - b["min_x"]) * F.col("col") / F.greatest(F.col(width) - 1, F.lit(1))
    y = b["max_y"] - (b["max_y"] - b["min_y"]) * F.col("row") / F.greatest(F.col(height) - 1, F.lit(1))
    z = F.when(is_nodata(F.col("z"), nodata), F.lit(0.0)).otherwise(F.col("z") - baseline)
    return cells.withColumn("x", x).withColumn("y", y).withColumn("z", z)


def faces(grids: DataFrame, width: str, height: str) -> DataFrame:
    """The four vertex numbers a, b, c, d of each quad of grids of width by height samples, row by row."""
    cut = grids.where((F.col(width) > 1) & (F.col(height) > 1))
    cut = cut.withColumn("qy", F.explode(F.sequence(F.lit(0), F.col(height) - 2))).withColumn("qx", F.explode(F.sequence(F.lit(0), F.col(width) - 2)))
    a = F.col("qy") * F.col(width) + F.col("qx")
    return cut.withColumn("a", a).withColumn("b", a + 1).withColumn("c", a + F.col(width) + 1).withColumn("d", a + F.col(width)).drop("qx", "qy")


def baseline(cells: DataFrame, by: tuple[str, ...], nodata: Column) -> DataFrame:
    """The lowest elevation of each raster without nodata, 0 where there is none."""
    z = F.when(~is_nodata(F.col("z"), nodata), F.col("z"))
    return cells.groupBy(*by).agg(F.coalesce(F.min(z), F.lit(0.0)).alias("baseline"))


def first_baseline(values: DataFrame, key: str, value: str, sequence: str) -> DataFrame:
    """The baseline that was stored first for each context; later ones don't replace it."""
    return values.groupBy(key).agg(F.min_by(value, F.col(sequence)).alias(value))


def sampled(points: DataFrame, cells: DataFrame, rasters: DataFrame, nodata: Column) -> DataFrame:
    """points (point_id, raster_id, x, y) with z by bilinear interpolation; null outside the box or beside nodata.

    rasters: raster_id, width, height, box. Each point asks for its four cells; the answers meet in an equi
    join on (raster_id, row, col) and are summed a point, so neither side is ever gathered. Cells of rasters that
    no point asks for go before they are dealt. Cells are often exploded from a few rows, which Spark takes for
    their size, so joins with them are told not to broadcast them.
    """
    wanted = F.broadcast(points.select("raster_id").distinct())  # a number a raster, of which cells are made
    at = points.join(rasters.join(wanted, "raster_id", "left_semi"), "raster_id")
    b = F.col("box")
    inside = (F.col("x") >= b["min_x"]) & (F.col("x") <= b["max_x"]) & (F.col("y") >= b["min_y"]) & (F.col("y") <= b["max_y"]) & (F.col("width") >= 2) & (F.col("height") >= 2)
    fx = (F.col("x") - b["min_x"]) / (b["max_x"] - b["min_x"]) * (F.col("width") - 1)
    fy = (b["max_y"] - F.col("y")) / (b["max_y"] - b["min_y"]) * (F.col("height") - 1)
    at = at.where(inside).select("point_id", "raster_id", fx.alias("fx"), fy.alias("fy"), "width", "height")
    c0, r0 = F.least(F.floor("fx").cast("int"), F.col("width") - 2), F.least(F.floor("fy").cast("int"), F.col("height") - 2)
    at = at.withColumn("c0", c0).withColumn("r0", r0).withColumn("u", F.col("fx") - F.col("c0")).withColumn("v", F.col("fy") - F.col("r0"))
    corner = lambda dr, dc: F.struct((F.col("r0") + dr).alias("row"), (F.col("c0") + dc).alias("col"), ((F.col("u") if dc else F.lit(1.0) - F.col("u")) * (F.col("v") if dr else F.lit(1.0) - F.col("v"))).alias("weight"))
    asked = at.select("point_id", "raster_id", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("k")).select("point_id", "raster_id", "k.*")
    valid = cells.join(wanted, "raster_id", "left_semi").where(~is_nodata(F.col("z"), nodata)).select("raster_id", "row", "col", "z")
    met = asked.join(valid.hint("merge"), ["raster_id", "row", "col"])
    z = met.groupBy("point_id", "raster_id").agg(F.sum(F.col("weight") * F.col("z")).alias("z"), F.count("*").alias("n")).where(F.col("n") == 4).drop("n")
    return points.join(z.hint("merge"), ["point_id", "raster_id"], "left")


def average(sampled_points: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The mean sampled elevation of each group, 0 without samples."""
    return sampled_points.groupBy(*by).agg(F.coalesce(F.avg("z"), F.lit(0.0)).alias("elevation"), F.count("z").alias("samples"))


def placed_elevation(z: Column, absolute: Column, base: Column) -> Column:
    """A sampled elevation above the shared baseline, or as it is for absolute coordinates."""
    return F.when(absolute, z).otherwise(z - base)


def meshed(cells: DataFrame, sites: DataFrame, most: int = MOST_SAMPLES) -> DataFrame:
    """raster_id, vertex, x, y, z of the meshes of elevation rasters: strided, placed and moved to the baseline.

    cells: raster_id, row, col, z; sites: raster_id, width, height, box, nodata, start (x, y), absolute. The
    baseline is the lowest cell, 0 for absolute coordinates; nodata lies on it. Rasters of a single row or
    column give none. Sites are few (a row a raster) and meet the cells in an equi join.
    """
    at = cells.hint("merge").join(sites, "raster_id").where((F.col("width") > 1) & (F.col("height") > 1))
    low = baseline(at.where(~F.col("absolute")), ("raster_id",), F.col("nodata"))
    kept = downsampled(at, "width", "height", most).join(low.hint("merge"), "raster_id", "left").withColumn("baseline", F.coalesce("baseline", F.lit(0.0)))
    b, zero = F.col("box"), F.lit(0.0)
    x = b["min_x"] + (b["max_x"] - b["min_x"]) / (F.col("width") - 1) * F.col("col") - F.when(F.col("absolute"), zero).otherwise(F.col("start.x"))
    y = b["max_y"] - (b["max_y"] - b["min_y"]) / (F.col("height") - 1) * F.col("row") - F.when(F.col("absolute"), zero).otherwise(F.col("start.y"))
    z = F.when(is_nodata(F.col("z"), F.col("nodata")), zero).otherwise(F.col("z") - F.col("baseline"))
    across = F.ceil(F.col("width") / stride(F.col("width"), most)).cast("int")
    return kept.select("raster_id", (F.col("sample_y") * across + F.col("sample_x")).alias("vertex"), x.alias("x"), y.alias("y"), z.alias("z"))


def vertex_normals(vertices: DataFrame, quads: DataFrame) -> DataFrame:
    """raster_id, vertex, normal (unit) of mesh vertices: the sum of the quads' normals around each; quads: raster_id, a, b, c, d."""
    corner = lambda name: vertices.select("raster_id", F.col("vertex").alias(name), F.struct("x", "y", "z").alias(f"p_{name}"))
    met = quads
    for name in "abcd":
        met = met.join(corner(name).hint("merge"), ["raster_id", name])
    e = lambda p, q, c: F.col(f"p_{q}")[c] - F.col(f"p_{p}")[c]  # noqa: E731  the cross product of both diagonals is twice the quad's normal
    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    n = F.struct(*((e("a", "c", i) * e("b", "d", j) - e("a", "c", j) * e("b", "d", i)).alias(k) for k, (i, j) in cross.items()))
    flat = met.select("raster_id", F.explode(F.array("a", "b", "c", "d")).alias("vertex"), n.alias("n"))
    summed = flat.groupBy("raster_id", "vertex").agg(*(F.sum(f"n.{c}").alias(c) for c in "xyz"))
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return summed.select("raster_id", "vertex", F.when(size > 0, F.struct(*((F.col(c) / size).alias(c) for c in "xyz"))).alias("normal"))
