"""Status rows beside results: level and message of what a load found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plural

#: Layers asked for at once from which a remark is due.
MANY_LAYERS = 8


def status(loads: DataFrame) -> DataFrame:
    """level and message of loads (features, cached): none is a warning, answers from a cache a remark."""
    level = F.when(F.col("features") == 0, "warning").when(F.col("cached"), "remark").otherwise("ok")
    message = F.when(F.col("features") == 0, F.lit("No features in the study area.")).otherwise(F.concat(F.lit("Loaded "), plural(F.col("features"), "feature"), F.when(F.col("cached"), F.lit(" from the cache.")).otherwise(F.lit("."))))
    return loads.withColumn("level", level).withColumn("message", message)


def categories(counts: DataFrame, by: tuple[str, ...], unavailable: str, cached: str) -> DataFrame:
    """One row a request of category counts (category, n and two booleans): totals, missing and cached categories, level."""
    listed = lambda flag: F.array_join(F.array_sort(F.collect_set(F.when(F.col(flag), F.col("category")))), ", ")
    rows = counts.groupBy(*by).agg(F.sum("n").alias("features"), listed(unavailable).alias("unavailable"), listed(cached).alias("cached"))
    return rows.withColumn("level", F.when((F.col("features") == 0) | (F.col("unavailable") != ""), "warning").when(F.col("cached") != "", "remark").otherwise("ok"))


def load_status(kind: str, count: Column, cached: Column, absolute: Column, large: Column, clipped: Column) -> Column:
    """struct<level,message> of a load of buildings, terrain, an image or a raster. Nothing found is a warning; clipped or large rasters are remarks."""
    what = {"buildings": plural(count, "building"), "terrain": F.lit("terrain coverage"), "image": F.lit("map image"), "raster": F.lit("raster")}[kind]
    none = (count == 0) if kind == "buildings" else F.lit(False)
    heights = F.when(absolute, F.lit(" with absolute elevation")).otherwise(F.lit(" on the shared elevation baseline")) if kind in ("buildings", "terrain") else F.lit("")
    notes = F.concat(F.when(clipped, F.lit(" Clipped to the study area.")).otherwise(F.lit("")), F.when(large, F.lit(" The raster is large.")).otherwise(F.lit(""))) if kind == "raster" else F.lit("")
    loaded = F.concat(F.when(cached, F.lit("Using cached ")).otherwise(F.lit("Loaded ")), what, heights, F.lit("."), notes)
    remark = (clipped | large) if kind == "raster" else cached if kind == "buildings" else F.lit(False)
    return F.struct(F.when(none, "warning").when(F.coalesce(remark, F.lit(False)), "remark").otherwise("ok").alias("level"), F.when(none, F.lit("No buildings in the study area.")).otherwise(loaded).alias("message"))


def layer_count_remark(layers: Column, direct: Column) -> Column:
    """A remark where more than MANY_LAYERS layers are asked for straight from a list; null otherwise."""
    return F.when(direct & (layers > MANY_LAYERS), F.concat(F.lit("Loading "), layers.cast("string"), F.lit(" layers at once.")))


def guarded(load, empty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """load() and a diagnostics row; on an error the empty result and a row that says so.

    Spark reads lazily, so the load is run once here (and forgotten) for errors of the reading itself to show.
    """
    spark = empty.sparkSession
    try:
        found = load()
        found.write.format("noop").mode("overwrite").save()
        return found, spark.createDataFrame([("ok", "")], "level string, message string")
    except Exception as error:  # noqa: BLE001  the message goes to the user instead
        return empty, spark.createDataFrame([("error", str(error).splitlines()[0][:500])], "level string, message string")
