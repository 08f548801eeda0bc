"""Geometry on arrays of points (structs x, y and perhaps z) as column expressions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import number


def _at(a: Column, i: Column) -> Column:
    return F.get(a, i)


def is_closed(ring: Column) -> Column:
    """At least two points, the first equal to the last."""
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return F.coalesce((F.size(ring) >= 2) & (first["x"] == last["x"]) & (first["y"] == last["y"]), F.lit(False))


def close(ring: Column, tolerance: float = 1e-9) -> Column:
    """The ring with its first point appended unless the last lies within tolerance of it on both axes."""
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    near = (F.abs(first["x"] - last["x"]) <= tolerance) & (F.abs(first["y"] - last["y"]) <= tolerance)
    return F.when((F.size(ring) > 0) & ~near, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def without_repeats(ring: Column, tolerance: float = 0.0) -> Column:
    """Points that differ from the last kept one by more than tolerance (a fold, as each test is against a kept point)."""
    start = F.slice(ring, 1, 1)

    def step(kept: Column, p: Column) -> Column:
        q = F.element_at(kept, -1)
        dx, dy = p["x"] - q["x"], p["y"] - q["y"]
        return F.when(dx * dx + dy * dy > tolerance * tolerance, F.concat(kept, F.array(p))).otherwise(kept)

    return F.when(F.size(ring) > 1, F.aggregate(F.slice(ring, F.lit(2), F.size(ring)), start, step)).otherwise(ring)


def twice_area(ring: Column) -> Column:
    """Twice the signed area (shoelace) of a ring, closed or not."""
    n = F.size(ring)
    term = lambda i: _at(ring, i)["x"] * _at(ring, (i + 1) % n)["y"] - _at(ring, (i + 1) % n)["x"] * _at(ring, i)["y"]
    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + term(i))).otherwise(F.lit(0.0))


def box(ring: Column) -> Column:
    """struct<min_x,min_y,max_x,max_y> of points; nulls for none."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def boxes_meet(a: Column, b: Column) -> Column:
    """Closed boxes that share a point."""
    return (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"]) & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])


def boxes_common(a: Column, b: Column) -> Column:
    """The box in both, null unless it has an area."""
    c = {"min_x": F.greatest(a["min_x"], b["min_x"]), "min_y": F.greatest(a["min_y"], b["min_y"]), "max_x": F.least(a["max_x"], b["max_x"]), "max_y": F.least(a["max_y"], b["max_y"])}
    return F.when((c["min_x"] < c["max_x"]) & (c["min_y"] < c["max_y"]), F.struct(*(v.alias(k) for k, v in c.items())))


def box_area(b: Column) -> Column:
    return (b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"])


def quantize(v: Column, tolerance: float) -> Column:
    """Steps of tolerance, half to even."""
    return F.rint(v / F.lit(tolerance)).cast("long")


def vertex_key(p: Column, tolerance: float = 0.001) -> Column:
    return F.concat_ws("|", *(quantize(p[c], tolerance).cast("string") for c in ("x", "y", "z")))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once: lambdas of higher-order functions bind, plain columns are pasted in again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _least_rotation(keys: Column) -> Column:
    """The least of the joined rotations of keys; only rotations from the least key can be the least."""
    n = F.size(keys)
    turn = lambda i: F.array_join(F.concat(F.slice(keys, i + 1, n), F.slice(keys, F.lit(1), i)), ";")
    least = F.array_min(F.transform(keys, lambda k: F.concat(k, F.lit(";"))))
    starts = lambda low: F.filter(F.transform(keys, lambda k, i: F.when(F.concat(k, F.lit(";")) == low, i)), lambda i: i.isNotNull())
    return bound(least, lambda low: F.array_min(F.transform(starts(low), turn)))


def ring_key(ring: Column, tolerance: float = 0.001) -> Column:
    """One text for a 3D ring, whatever vertex it starts at and whichever way it runs; a closing vertex is left out."""

    def of(keys: Column) -> Column:
        open_ = F.when((F.size(keys) > 1) & (F.get(keys, F.lit(0)) == F.get(keys, F.size(keys) - 1)), F.slice(keys, F.lit(1), F.size(keys) - 1)).otherwise(keys)
        return bound(open_, lambda k: F.when(F.size(k) > 0, F.least(_least_rotation(k), bound(F.reverse(k), _least_rotation))).otherwise(F.lit("")))

    return bound(F.transform(ring, lambda p: vertex_key(p, tolerance)), of)


def vertex(p: Column, tolerance: float = 0.001) -> Column:
    """struct<x,y,z>: a 3D point in whole steps of tolerance."""
    return F.struct(*(quantize(p[c], tolerance).alias(c) for c in "xyz"))


def _least_turn(keys: Column) -> Column:
    """The least rotation of an array; only rotations from a least element can be it."""
    n = F.size(keys)
    turn = lambda i: F.concat(F.slice(keys, i + 1, n), F.slice(keys, F.lit(1), i))
    starts = lambda low: F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(keys, i) == low)
    return bound(F.array_min(keys), lambda low: F.array_min(F.transform(starts(low), turn)))


def ring_form(ring: Column, tolerance: float = 0.001) -> Column:
    """array<struct<x,y,z>>: what ring_key tells apart, as whole numbers."""

    def of(keys: Column) -> Column:
        open_ = F.when((F.size(keys) > 1) & (F.get(keys, F.lit(0)) == F.get(keys, F.size(keys) - 1)), F.slice(keys, F.lit(1), F.size(keys) - 1)).otherwise(keys)
        return bound(open_, lambda k: F.when(F.size(k) > 0, F.least(_least_turn(k), bound(F.reverse(k), _least_turn))).otherwise(k))

    return bound(F.transform(ring, lambda p: vertex(p, tolerance)), of)


def surface_form(outer: Column, inners: Column, tolerance: float = 0.001) -> Column:
    """struct<outer,inners>: what surface_key tells apart, as whole numbers; holes in order."""
    return F.struct(ring_form(outer, tolerance).alias("outer"), F.array_sort(F.transform(inners, lambda r: ring_form(r, tolerance))).alias("inners"))


def surface_key(outer: Column, inners: Column, tolerance: float = 0.001) -> Column:
    """The outer ring's key, then the holes' keys in order, joined by two bars."""
    return F.concat_ws("||", ring_key(outer, tolerance), F.array_join(F.array_sort(F.transform(inners, lambda r: ring_key(r, tolerance))), "||"))


def numbers(text: Column) -> Column:
    """Doubles in white-space separated text, null where a token isn't one."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.transform(tokens, number)


def points_2d(text: Column, stride: Column | int = 2) -> Column:
    """Points of a position list; coordinates past the second of each stride are ignored, unreadable pairs skipped."""
    v, d = numbers(text), F.lit(stride) if isinstance(stride, int) else stride
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 2, F.lit(0)), d), lambda i: F.struct(_at(v, i).alias("x"), _at(v, i + 1).alias("y")))
    return F.when(F.size(v) >= 2, F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())).otherwise(F.filter(pairs, lambda p: F.lit(False)))


def points_3d(text: Column, dimension: Column, srs: Column) -> Column:
    """Points with z. A missing dimension is 3 for systems with heights if the count divides by 3, else 2 (z is 0)."""
    v = numbers(text)
    tall = srs.contains("7423") | srs.contains("4979")
    d = F.coalesce(dimension, F.when(tall & (F.size(v) % 3 == 0), F.lit(3)).otherwise(F.lit(2)))
    point = lambda i: F.struct(_at(v, i).alias("x"), _at(v, i + 1).alias("y"), F.when(d >= 3, _at(v, i + 2)).otherwise(F.lit(0.0)).alias("z"))
    points = F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - d, F.lit(0)), d), point)
    return F.when(F.size(v) >= d, F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull())).otherwise(F.filter(points, lambda p: F.lit(False)))


def swapped_north_first(p: Column, srs: Column) -> Column:
    """x and y exchanged where an EPSG system's pair has a northing of a million or more before a smaller easting."""
    swap = F.upper(srs).contains("EPSG") & (F.abs(p["x"]) >= 1e6) & (F.abs(p["y"]) < 1e6)
    return F.when(F.coalesce(swap, F.lit(False)), F.struct(p["y"].alias("x"), p["x"].alias("y"))).otherwise(F.struct(p["x"].alias("x"), p["y"].alias("y")))


def swapped_lat_first(p: Column, srs: Column) -> Column:
    """For geographic systems, exchanged where the first must be a latitude, or is the larger of two that could be; else as north first."""
    x, y = F.abs(p["x"]), F.abs(p["y"])
    geographic = F.coalesce(srs.rlike("4326|7423|4283|7844"), F.lit(False))
    north = F.coalesce(F.upper(srs).contains("EPSG") & (x >= 1e6) & (y < 1e6), F.lit(False))
    swap = F.when(geographic & (x <= 90) & (y <= 180) & (y > 90), F.lit(True)).when(geographic & (x <= 180) & (x > 90) & (y <= 90), F.lit(False)).when(geographic & (x <= 90) & (y <= 90), x > y).otherwise(north)
    return F.when(swap, F.struct(p["y"].alias("x"), p["x"].alias("y"))).otherwise(F.struct(p["x"].alias("x"), p["y"].alias("y")))


def newell(ring: Column) -> Column:
    """struct<x,y,z>: the normal of a 3D ring, not of unit length."""
    n = F.size(ring)

    def part(a: str, b: str) -> Column:
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + (_at(ring, i)[a] - _at(ring, (i + 1) % n)[a]) * (_at(ring, i)[b] + _at(ring, (i + 1) % n)[b]))

    return F.when(n >= 3, F.struct(part("y", "z").alias("x"), part("z", "x").alias("y"), part("x", "y").alias("z")))


def centre(ring: Column) -> Column:
    """struct<x,y,z>: the middle of a 3D ring's box."""
    def middle(c: str) -> Column:
        v = F.transform(ring, lambda p: p[c])
        return (F.array_min(v) + F.array_max(v)) / F.lit(2.0)

    return F.struct(*(middle(c).alias(c) for c in ("x", "y", "z")))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = _at(ring, i), _at(ring, (i + 1) % n)
        return F.when((a["y"] > y) != (b["y"] > y), x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).otherwise(F.lit(False))

    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda acc, i: acc != crosses(i))).otherwise(F.lit(False))


def between(a: Column, b: Column, t: Column) -> Column:
    """Linear interpolation."""
    return a + (b - a) * t


def within(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def kept_holes(inners: Column, threshold: Column) -> Column:
    """Holes at least as large as threshold; all of them where it isn't positive."""
    return F.when(threshold > 0, F.filter(inners, lambda r: F.abs(twice_area(r)) / 2.0 >= threshold)).otherwise(inners)


def ring_middle(ring: Column) -> Column:
    """struct<x,y>: the centroid of a 2D ring without closing point; null without an area."""
    n, area = F.size(ring), twice_area(ring)
    cross = lambda i: _at(ring, i)["x"] * _at(ring, (i + 1) % n)["y"] - _at(ring, (i + 1) % n)["x"] * _at(ring, i)["y"]
    total = lambda c: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + (_at(ring, i)[c] + _at(ring, (i + 1) % n)[c]) * cross(i))
    return F.when(F.abs(area) > 1e-9, F.struct((total("x") / (area * 3.0)).alias("x"), (total("y") / (area * 3.0)).alias("y")))


def usable_holes(outer: Column, inners: Column, tolerance: float, vertex: float = 0.001) -> Column:
    """Holes of a 2D ring that are large enough and whose centroid isn't outside it."""
    least = max(tolerance * tolerance * 16.0, vertex * vertex * 4.0)

    def good(r: Column) -> Column:
        return bound(ring_middle(r), lambda m: F.coalesce((F.abs(twice_area(r)) / 2.0 > least) & point_in_ring(m["x"], m["y"], outer), F.lit(False)))

    return F.filter(inners, good)


def boundary(outer: Column, inners: Column) -> Column:
    """struct<outer,inners>: the outer ring counter-clockwise, holes clockwise."""
    turned = lambda r, sign: F.when(twice_area(r) * sign < 0, F.reverse(r)).otherwise(r)
    return F.struct(turned(outer, 1.0).alias("outer"), F.transform(inners, lambda r: turned(r, -1.0)).alias("inners"))


def coordinates(ring: Column, name: str) -> Column:
    """One coordinate of a ring's points."""
    return F.transform(ring, lambda p: p[name])


def longest_edge_middle(ring: Column) -> Column:
    """struct<x,y,z>: the middle of a 3D ring's longest edge, of equal ones the first; null for fewer than two points."""
    n = F.size(ring)

    def edge(i: Column) -> Column:
        a, b = _at(ring, i), _at(ring, (i + 1) % n)
        square = sum(((b[c] - a[c]) * (b[c] - a[c]) for c in "yz"), (b["x"] - a["x"]) * (b["x"] - a["x"]))
        return F.struct((-square).alias("order"), i.alias("i"), F.struct(*(((a[c] + b[c]) / 2.0).alias(c) for c in "xyz")).alias("middle"))

    return F.when(n >= 2, F.array_min(F.transform(F.sequence(F.lit(0), n - 1), edge))["middle"])


def usable(ring: Column, tolerance: float) -> Column:
    """Whether a 3D face is larger than tolerance: its box's diagonal, and its area than the square of it."""

    def size(r: Column) -> Column:
        spans = [F.array_max(v) - F.array_min(v) for v in (coordinates(r, c) for c in "xyz")]
        area = lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]) / 2.0
        wide = F.sqrt(spans[0] * spans[0] + spans[1] * spans[1] + spans[2] * spans[2]) > tolerance
        return wide & bound(newell(r), lambda v: area(v) > tolerance * tolerance)

    return F.coalesce(bound(ring, size), F.lit(False))
