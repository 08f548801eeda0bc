"""Service requests as text columns: what the engine pushes down to remote sources, compiled for whole tables at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bbox_text, escape, plain_double

# Query keys that the compiler sets itself, a service each.
RESERVED = {
    "wfs": ("SERVICE", "REQUEST", "VERSION", "TYPENAME", "TYPENAMES", "SRSNAME", "CRSNAME", "MAXFEATURES", "COUNT", "OUTPUTFORMAT", "BBOX"),
    "wms": ("SERVICE", "REQUEST", "VERSION", "LAYERS", "STYLES", "CRS", "SRS", "BBOX", "WIDTH", "HEIGHT", "FORMAT", "TRANSPARENT"),
    "wcs": ("SERVICE", "REQUEST", "VERSION", "COVERAGEID", "FORMAT", "SUBSET"),
}
#: Elements and tag filters that a category of tagged elements asks for.
WAY, BOTH = ("way",), ("way", "relation")
CATEGORIES = ("buildings", "roads", "water", "green", "rail")
OSM_FILTERS = {
    "buildings": ((BOTH, '"building"'), (BOTH, '"building:part"')),
    "roads": ((WAY, '"highway"~"^(motorway|trunk|primary|secondary|tertiary|motorway_link|trunk_link|primary_link|secondary_link|tertiary_link|residential|service|unclassified)$"'),),
    "water": ((BOTH, '"natural"="water"'), (BOTH, '"water"~"^(river|canal|lake|pond|reservoir)$"'), (BOTH, '"landuse"="reservoir"'), (BOTH, '"waterway"="riverbank"')),
    "green": ((BOTH, '"landuse"~"^(grass|meadow)$"'), (BOTH, '"leisure"="park"'), (BOTH, '"natural"~"^(wood|grassland)$"')),
    "rail": ((WAY, '"railway"~"^(rail|light_rail|tram|subway|narrow_gauge)$"'),),
}
#: Longest tile edge in degrees by category, most tiles an axis, and the largest site asked for in one request.
TILE_EDGE = {"green": 0.0025, "water": 0.0035, "buildings": 0.0045, "roads": 0.0045, "rail": 0.0060}
MOST_TILES, COMBINED = 4, 0.0045


def _kept(url: Column, service: str) -> tuple[Column, Column]:
    """The path of a url and its query parts without reserved keys."""
    trimmed = F.trim(url)
    path, query = F.split_part(trimmed, F.lit("?"), F.lit(1)), F.regexp_extract(trimmed, r"^[^?]*\?(?s)(.*)$", 1)
    reserved = F.array(*map(F.lit, RESERVED[service]))
    raw = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    return path, F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(reserved, F.upper(F.coalesce(F.try_url_decode(raw(p)), raw(p)))))


def base_url(url: Column, service: str) -> Column:
    """The url without reserved query keys (case and percent escapes ignored); other parts keep their order and form."""
    path, kept = _kept(url, service)
    return F.concat_ws("?", path, F.nullif(F.array_join(kept, "&"), F.lit("")))


def _start(url: Column, service: str) -> Column:
    path, kept = _kept(url, service)
    return F.concat(F.concat_ws("?", path, F.array_join(F.concat(kept, F.array(F.lit(""))), "&")))


def _if(condition: Column, *parts: Column) -> Column:
    return F.when(condition, F.concat(*parts)).otherwise(F.lit(""))


def _given(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def get_capabilities(url: Column, service: str, version: Column) -> Column:
    return F.concat(_start(url, service), F.lit(f"SERVICE={service.upper()}&VERSION="), escape(version), F.lit("&REQUEST=GetCapabilities"))


def get_feature(url: Column, version: Column, type_name: Column, srs: Column, limit: Column, output_format: Column, box: Column) -> Column:
    """A feature request; blank or null options are left out, a limit of 0 means all."""
    return F.concat(
        _start(url, "wfs"), F.lit("SERVICE=WFS&VERSION="), escape(version), F.lit("&REQUEST=GetFeature"), F.when(version.startswith("2."), "&TYPENAMES=").otherwise("&TYPENAME="), escape(type_name),
        _if(_given(srs), F.lit("&SRSNAME="), escape(srs)), _if(F.coalesce(limit > 0, F.lit(False)), F.lit("&MAXFEATURES="), limit.cast("string"), F.lit("&COUNT="), limit.cast("string")),
        _if(_given(output_format), F.lit("&OUTPUTFORMAT="), escape(output_format)), _if(box.isNotNull(), F.lit("&BBOX="), F.when(_given(srs), bbox_text(box, srs)).otherwise(bbox_text(box))),
    )


def get_map(url: Column, version: Column, layer: Column, srs: Column, box: Column, width: Column, height: Column, image_format: Column, transparent: Column) -> Column:
    return F.concat(
        _start(url, "wms"), F.lit("SERVICE=WMS&VERSION="), escape(version), F.lit("&REQUEST=GetMap&LAYERS="), escape(layer), F.lit("&STYLES="), F.when(version.startswith("1.3"), "&CRS=").otherwise("&SRS="), escape(srs),
        F.lit("&BBOX="), bbox_text(box), F.lit("&WIDTH="), width.cast("string"), F.lit("&HEIGHT="), height.cast("string"), F.lit("&FORMAT="), escape(image_format), F.lit("&TRANSPARENT="), F.when(transparent, "TRUE").otherwise("FALSE"),
    )


def describe_coverage(url: Column, version: Column, coverage: Column) -> Column:
    return F.concat(_start(url, "wcs"), F.lit("SERVICE=WCS&REQUEST=DescribeCoverage&VERSION="), escape(version), F.lit("&COVERAGEID="), escape(coverage))


def get_coverage(url: Column, version: Column, coverage: Column, srs: Column, box: Column, coverage_format: Column, axis_x: Column, axis_y: Column) -> Column:
    def subset(axis: Column, other: str, low: str, high: str) -> list[Column]:
        return [F.lit("&SUBSET="), F.when(_given(axis), axis).otherwise(other), F.lit("("), plain_double(box[low]), F.lit(","), plain_double(box[high]), F.lit(")")]

    return F.concat(
        _start(url, "wcs"), F.lit("SERVICE=WCS&REQUEST=GetCoverage&VERSION="), escape(version), F.lit("&COVERAGEID="), escape(coverage), F.lit("&FORMAT="), escape(coverage_format),
        *subset(axis_x, "x", "min_x", "max_x"), *subset(axis_y, "y", "min_y", "max_y"), F.lit("&SUBSETTINGCRS="), escape(srs), F.lit("&OUTPUTCRS="), escape(srs),
    )


def overpass(box: Column, wanted: dict[str, Column], timeout: Column) -> Column:
    """A query for tagged elements of the wanted categories (booleans by name) inside a box."""
    where = F.concat(F.lit("("), F.concat_ws(",", *(plain_double(box[c]) for c in ("min_y", "min_x", "max_y", "max_x"))), F.lit(")"))
    parts = [_if(wanted[c], *(x for kinds, tag in OSM_FILTERS[c] for kind in kinds for x in (F.lit(f"{kind}[{tag}]"), where, F.lit(";")))) for c in CATEGORIES if c in wanted]
    return F.concat(F.lit("[out:json][timeout:"), F.greatest(timeout, F.lit(10)).cast("string"), F.lit("];("), *parts, F.lit(");out geom;"))


def tile_count(span: Column, edge: Column) -> Column:
    """Tiles along an axis: as few as keep to the edge, 1 to MOST_TILES."""
    return F.least(F.lit(MOST_TILES), F.greatest(F.lit(1), F.ceil(span / edge).cast("int")))


def image_size(box: Column, most_width: Column, most_height: Column, side: int = 6144, pixels: int = 24_000_000) -> Column:
    """struct<width,height> of an image with the box's aspect within the service's and the engine's limits."""
    limit = lambda m: F.when(F.coalesce(m > 0, F.lit(False)), F.least(m.cast("int"), F.lit(side))).otherwise(F.lit(side))
    w, h = limit(most_width), limit(most_height)
    aspect = F.greatest(box["max_x"] - box["min_x"], F.lit(1e-9)) / F.greatest(box["max_y"] - box["min_y"], F.lit(1e-9))
    whole = lambda v: F.greatest(F.lit(1), F.rint(v).cast("int"))
    wide_h, tall_w = whole(w / aspect), whole(h * aspect)
    wide = F.when(wide_h > h, F.struct(whole(w * (h / wide_h)).alias("width"), h.alias("height"))).otherwise(F.struct(w.alias("width"), wide_h.alias("height")))
    tall = F.when(tall_w > w, F.struct(w.alias("width"), whole(h * (w / tall_w)).alias("height"))).otherwise(F.struct(tall_w.alias("width"), h.alias("height")))
    first = F.when(aspect >= 1.0, wide).otherwise(tall)
    count = first["width"].cast("double") * first["height"]
    scale = F.sqrt(F.lit(float(pixels)) / count)
    return F.when(count > pixels, F.struct(whole(first["width"] * scale).alias("width"), whole(first["height"] * scale).alias("height"))).otherwise(first)


def reduced(width: Column, height: Column, least: int = 512) -> Column:
    """The next smaller struct<width,height> to try, null where neither side would shrink."""
    w, h = (F.greatest(F.lit(least), F.floor(x * F.lit(0.85)).cast("int")) for x in (width, height))
    return F.when(~((w >= width) & (h >= height)), F.struct(w.alias("width"), h.alias("height")))
