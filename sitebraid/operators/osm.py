"""Tagged elements: categories, heights, widths, merging of overlapping answers, request plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import requests
from ..functions.text import osm_double, osm_length

# Classes and widths in metres, accepted tags.
ROAD_WIDTHS = {"motorway": 18.0, "trunk": 16.0, "primary": 14.0, "secondary": 12.0, "tertiary": 10.0, "motorway_link": 10.0, "trunk_link": 9.0, "primary_link": 8.0, "secondary_link": 7.0, "tertiary_link": 6.0, "residential": 7.0, "service": 5.0, "unclassified": 6.5}
OTHER_ROAD = 8.0
WATER_KINDS = ("river", "canal", "lake", "pond", "reservoir")
RAILS = ("rail", "light_rail", "tram", "narrow_gauge")
RAIL_WIDTHS = {"rail": 5.0, "light_rail": 4.0, "tram": 3.5, "subway": 4.5, "narrow_gauge": 3.5}
OTHER_RAIL, LEAST_RAIL = 4.0, 3.0
STOREY, LEAST_HEIGHT = 3.0, 4.0


def _tag(tags: Column, key: str) -> Column:
    return F.element_at(tags, F.lit(key))


def _is(tags: Column, key: str, value: str) -> Column:
    """Whether a tag has a value, case ignored."""
    return F.coalesce(F.lower(_tag(tags, key)) == value, F.lit(False))


def _in(tags: Column, key: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(_tag(tags, key).isin(*values), F.lit(False))


def _filled(tags: Column, key: str) -> Column:
    return F.coalesce(F.trim(_tag(tags, key)) != "", F.lit(False))


def is_building(tags: Column) -> Column:
    return _filled(tags, "building") | _filled(tags, "building:part")


def is_road(tags: Column) -> Column:
    return _in(tags, "highway", tuple(ROAD_WIDTHS))


def is_hidden_water(tags: Column) -> Column:
    """Water that isn't seen: intermittent, covered, underground, in a tunnel or a ditch."""
    out = _is(tags, "intermittent", "yes") | _is(tags, "seasonal", "yes") | _is(tags, "covered", "yes") | _is(tags, "location", "underground") | _is(tags, "location", "underwater")
    out = out | (_filled(tags, "tunnel") & ~_is(tags, "tunnel", "no"))
    return out | _is(tags, "waterway", "ditch") | _is(tags, "waterway", "drain") | _is(tags, "waterway", "culvert")


def is_water(tags: Column) -> Column:
    return ~is_hidden_water(tags) & (_is(tags, "natural", "water") | _is(tags, "waterway", "riverbank") | _in(tags, "water", WATER_KINDS) | _is(tags, "landuse", "reservoir"))


def is_green(tags: Column) -> Column:
    return _in(tags, "landuse", ("grass", "meadow")) | _is(tags, "leisure", "park") | _in(tags, "natural", ("wood", "grassland"))


def is_rail(tags: Column) -> Column:
    hidden = _is(tags, "location", "underground") | _is(tags, "covered", "yes") | (_filled(tags, "tunnel") & ~_is(tags, "tunnel", "no"))
    return _in(tags, "railway", RAILS) & ~hidden


def category(tags: Column, area: Column, line: Column) -> Column:
    """The category of an element; area and line say whether it has a ring or a line.

    Buildings come first and are used up even without a ring (null then); the others fall through to the
    next when their geometry is missing. Elements without tags have none. What tags is made of is computed once.
    """
    return g.bound(F.struct(tags.alias("tags"), area.alias("area"), line.alias("line")), lambda e: _category(e["tags"], e["area"], e["line"]))


def _category(tags: Column, area: Column, line: Column) -> Column:
    return (
        F.when(tags.isNull() | (F.cardinality(tags) == 0), F.lit(None).cast("string"))
        .when(is_building(tags), F.when(area, F.lit("buildings")))
        .when(is_road(tags) & line, "roads")
        .when(is_water(tags) & area, "water")
        .when(is_green(tags) & area, "green")
        .when(is_rail(tags) & line, "rail")
    )


def building_height(tags: Column) -> Column:
    """Metres: height, building:height, levels times a storey, or the least height; never below that."""
    h = F.coalesce(osm_length(_tag(tags, "height")), osm_length(_tag(tags, "building:height")), osm_double(_tag(tags, "building:levels")) * STOREY, F.lit(LEAST_HEIGHT))
    return F.greatest(h, F.lit(LEAST_HEIGHT))


def building_base(tags: Column) -> Column:
    return F.greatest(F.coalesce(osm_length(_tag(tags, "min_height")), osm_double(_tag(tags, "building:min_level")) * STOREY, F.lit(0.0)), F.lit(0.0))


def road_width(tags: Column) -> Column:
    """Metres: a tagged width (4 at least), lanes times 3.25 (6 at least), else the class's width."""
    by_class = None
    for name, w in ROAD_WIDTHS.items():
        by_class = (F.when if by_class is None else by_class.when)(_tag(tags, "highway") == name, F.lit(w))
    lanes = osm_double(_tag(tags, "lanes"))
    width = osm_length(_tag(tags, "width"))
    return F.when(width.isNotNull(), F.greatest(width, F.lit(4.0))).when(lanes.isNotNull(), F.greatest(lanes * 3.25, F.lit(6.0))).otherwise(F.coalesce(by_class, F.lit(OTHER_ROAD)))


def clean_up(width: Column, tolerance: float) -> Column:
    """struct<cleanup,smoothing,hole_area> for surfaces of roads of a typical width."""
    t = float(tolerance)
    return F.struct(
        F.greatest(F.lit(max(0.9, 6 * t)), F.least(width * 0.24, F.lit(6.0))).alias("cleanup"),
        F.greatest(F.lit(max(2.0, 4 * t)), F.least(width * 0.35, F.lit(10.0))).alias("smoothing"),
        F.greatest(F.lit(max(20.0, 100 * t * t)), F.least(width * width * 1.5, F.lit(180.0))).alias("hole_area"),
    )


def typical_width(df: DataFrame, by: tuple[str, ...], width: str, tolerance: float) -> DataFrame:
    """The upper median of each group's widths above tolerance, max(6, 10 tolerance) where there is none.

    Counts of equal widths are summed before the shuffle, so a group's rows never meet in one task whole.
    """
    usable = df.where(F.col(width) > tolerance).groupBy(*by, F.col(width).alias("w")).agg(F.count("*").alias("n"))
    lists = usable.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("a"), F.sum("n").alias("total"))
    found = lists.select(*by, F.expr("aggregate(a, named_struct('seen', 0L, 'w', cast(null as double)), (s, x) -> if(s.w is not null, s, if(s.seen + x.n > floor(total / 2), named_struct('seen', s.seen, 'w', x.w), named_struct('seen', s.seen + x.n, 'w', cast(null as double)))), s -> s.w)").alias("width"))
    groups = df.select(*by).distinct()
    return groups.join(found, list(by), "left").withColumn("width", F.coalesce("width", F.lit(max(6.0, 10 * tolerance))))


def merge_last(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """One row a key: the last by sequence, with the place of the first (merged answers keep the order of first sight)."""
    row = F.struct(*[c for c in df.columns if c != key])
    merged = df.groupBy(key).agg(F.max_by(row, F.col(sequence)).alias("_row"), F.min(sequence).alias("first_seen"))
    return merged.select(key, "first_seen", "_row.*")


def tiles(df: DataFrame, box: str, edge: Column) -> DataFrame:
    """Rows of df once a tile (iy, ix, tile box): rows of tiles from the south, each from the west; the last tile ends at the box."""
    b = F.col(box)
    cut = df.withColumn("_nx", requests.tile_count(b["max_x"] - b["min_x"], edge)).withColumn("_ny", requests.tile_count(b["max_y"] - b["min_y"], edge))
    cut = cut.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1)))

    def at(axis: str, i: Column, n: str) -> Column:
        return b[f"min_{axis}"] + (b[f"max_{axis}"] - b[f"min_{axis}"]) / F.col(n) * i

    tile = F.struct(at("x", F.col("ix"), "_nx").alias("min_x"), at("y", F.col("iy"), "_ny").alias("min_y"), F.when(F.col("ix") == F.col("_nx") - 1, b["max_x"]).otherwise(at("x", F.col("ix") + 1, "_nx")).alias("max_x"), F.when(F.col("iy") == F.col("_ny") - 1, b["max_y"]).otherwise(at("y", F.col("iy") + 1, "_ny")).alias("max_y"))
    return cut.withColumn("tile", tile).drop("_nx", "_ny")


def combined(box: Column, wanted: dict[str, Column]) -> Column:
    """Whether one request serves all wanted categories: more than one, no water, and a small site."""
    count = sum((w.cast("int") for w in wanted.values()), F.lit(0))
    return ~wanted["water"] & (count > 1) & (F.greatest(box["max_x"] - box["min_x"], F.lit(0.0)) <= requests.COMBINED) & (F.greatest(box["max_y"] - box["min_y"], F.lit(0.0)) <= requests.COMBINED)


def rail_width(tags: Column) -> Column:
    """Metres: a tagged width (3 at least), else the kind's."""
    by_kind = F.coalesce(*(F.when(_tag(tags, "railway") == kind, F.lit(w)) for kind, w in RAIL_WIDTHS.items()), F.lit(OTHER_RAIL))
    width = osm_length(_tag(tags, "width"))
    return F.when(width.isNotNull(), F.greatest(width, F.lit(LEAST_RAIL))).otherwise(by_kind)


def plan_elevation(samples: DataFrame, by: tuple[str, ...], absolute: str, z: str) -> DataFrame:
    """by, elevation shared by all features of a plan: the mean of all their points' samples; 0 for local coordinates or without samples."""
    return samples.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col(absolute), F.col(z))), F.lit(0.0)).alias("elevation"))


def green_faces(areas: DataFrame, rings: str) -> DataFrame:
    """A row an outer ring of green areas (holes ignored, nothing merged) with its face: the ring closed, four points at least and an area."""
    from ..functions import geometry as g

    cut = areas.withColumn("ring_index", F.sequence(F.lit(0), F.size(rings) - 1)).where(F.size(rings) > 0)
    cut = cut.withColumn("_r", F.explode(F.arrays_zip(F.col("ring_index").alias("i"), F.col(rings).alias("r")))).withColumn("ring_index", F.col("_r.i")).withColumn("face", g.bound(g.without_repeats(F.col("_r.r"), 0.001), g.close))
    return cut.where(g.bound(F.col("face"), lambda f: (F.size(f) >= 4) & (F.abs(g.twice_area(f)) > 1e-9))).drop("_r")


def rail_lines(rails: DataFrame, line: str, source: str, target: str, start: Column) -> DataFrame:
    """Rails as open lines in the target system at height 0; those with a point that has no image, or fewer than two, go."""
    from .massing import placed_line

    placed = rails.withColumn(line, placed_line(F.col(line), source, target, start)).where(F.size(line) >= 2)
    return placed.withColumn(line, F.transform(line, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(0.0).alias("z"))))
