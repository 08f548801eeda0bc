"""Georeferenced rasters: boxes from headers, overlap with a site, clipping windows, size flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import box_area, boxes_common

#: Sizes from which a raster is called large; overlap from which it isn't clipped; most shear of an affine.
LARGE_PIXELS, LARGE_BYTES, WHOLE_OVERLAP, MOST_SHEAR = 40_000_000, 200 * 1024 * 1024, 0.999, 1e-9


def _box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(F.least(x0, x1).alias("min_x"), F.least(y0, y1).alias("min_y"), F.greatest(x0, x1).alias("max_x"), F.greatest(y0, y1).alias("max_y"))


def box_from_tiepoint(width: Column, height: Column, scale: Column, tie: Column) -> Column:
    """The box of a raster from its pixel scale (sx, sy, ..) and tie point (i, j, k, x, y, ..); null if either is short or flat."""
    sx, sy = F.get(scale, F.lit(0)), F.get(scale, F.lit(1))
    left = F.get(tie, F.lit(3)) - F.get(tie, F.lit(0)) * sx
    top = F.get(tie, F.lit(4)) + F.get(tie, F.lit(1)) * sy
    good = (F.size(scale) >= 2) & (F.size(tie) >= 6) & (sx > 0) & (sy > 0)
    return F.when(good, _box(left, top - height * sy, left + width * sx, top))


def box_from_affine(width: Column, height: Column, m: Column) -> Column:
    """The same from a 4x4 transformation; null for rotated or sheared rasters."""
    at = lambda i: F.get(m, F.lit(i))
    good = (F.size(m) >= 8) & (F.abs(at(1)) <= MOST_SHEAR) & (F.abs(at(4)) <= MOST_SHEAR)
    return F.when(good, _box(at(3), at(7), at(3) + at(0) * width, at(7) + at(5) * height))


def overlap(raster: Column, site: Column) -> Column:
    """The share of the raster's box inside the site's, 0 to 1."""
    return F.coalesce(box_area(boxes_common(raster, site)) / box_area(raster), F.lit(0.0))


def clip_window(raster: Column, site: Column) -> Column:
    """struct<u0,v0,u1,v1> of the part inside the site; the whole where nearly all is inside, null where none is."""
    common, ratio = boxes_common(raster, site), overlap(raster, site)
    u = lambda x: (x - raster["min_x"]) / (raster["max_x"] - raster["min_x"])
    v = lambda y: (y - raster["min_y"]) / (raster["max_y"] - raster["min_y"])
    part = F.struct(u(common["min_x"]).alias("u0"), v(common["min_y"]).alias("v0"), u(common["max_x"]).alias("u1"), v(common["max_y"]).alias("v1"))
    whole = F.struct(F.lit(0.0).alias("u0"), F.lit(0.0).alias("v0"), F.lit(1.0).alias("u1"), F.lit(1.0).alias("v1"))
    return F.when(ratio >= WHOLE_OVERLAP, whole).when(ratio > 0, part)


def is_large(width: Column, height: Column, size: Column) -> Column:
    return (width.cast("long") * height.cast("long") > LARGE_PIXELS) | (size > LARGE_BYTES)


def clamped(request: Column, native: Column) -> Column:
    """The request inside the native bounds; the request itself where they have nothing in common."""
    return F.coalesce(boxes_common(request, native), request)
