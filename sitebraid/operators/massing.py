"""Building masses, faces and their planes, placed polylines, image quads and mesh normals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import srs
from . import osm


def mass(ring: Column, tags: Column, ground: Column, tolerance: float = 0.01) -> Column:
    """struct<area,base,top,height,volume> of a footprint: raised by its minimum height, at least tolerance high."""
    height, low = osm.building_height(tags), osm.building_base(tags)
    rise = F.greatest(F.lit(float(tolerance)), height - low)
    area = F.abs(g.twice_area(ring)) / 2.0
    return F.struct(area.alias("area"), (ground + low).alias("base"), (ground + low + rise).alias("top"), rise.alias("height"), (area * rise).alias("volume"))


def unit(v: Column) -> Column:
    size = lambda w: F.sqrt(w["x"] * w["x"] + w["y"] * w["y"] + w["z"] * w["z"])
    return g.bound(v, lambda w: g.bound(size(w), lambda n: F.when(n > 1e-30, F.struct(*((w[c] / n).alias(c) for c in "xyz")))))


#: Within this distance two vertices are one.
VERTEX = 0.001


def cross(a: Column, b: Column) -> Column:
    """struct<x,y,z>: the cross product of two vectors."""
    part = lambda i, j: a[i] * b[j] - a[j] * b[i]
    return F.struct(part("y", "z").alias("x"), part("z", "x").alias("y"), part("x", "y").alias("z"))


def fitted_plane(points: Column) -> Column:
    """struct<origin,normal>: the plane of least squared distances from 3D points, through their middle.

    The normal is the eigenvector of the least eigenvalue of their scatter matrix, in closed form, turned to the side
    of their ring's own normal; where rounding hides it (points within some 1:3000 of a line), the ring's own normal.
    Null for fewer than three points and for points on a line.
    """

    def scatter(r: Column, m: Column) -> Column:
        total = lambda i, j: F.aggregate(r, F.lit(0.0), lambda acc, p: acc + (p[i] - m[i]) * (p[j] - m[j])) / F.size(r)
        return F.struct(*(total(*k).alias(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz")))

    def least(s: Column) -> Column:
        """The least eigenvalue of a symmetric matrix."""
        q = (s["xx"] + s["yy"] + s["zz"]) / 3.0

        def of(b: Column) -> Column:
            p = F.sqrt((b["x"] * b["x"] + b["y"] * b["y"] + b["z"] * b["z"] + 2.0 * (s["xy"] * s["xy"] + s["xz"] * s["xz"] + s["yz"] * s["yz"])) / 6.0)
            det = b["x"] * (b["y"] * b["z"] - s["yz"] * s["yz"]) - s["xy"] * (s["xy"] * b["z"] - s["yz"] * s["xz"]) + s["xz"] * (s["xy"] * s["yz"] - b["y"] * s["xz"])
            turn = lambda size: F.acos(g.within(det / (2.0 * size * size * size), F.lit(-1.0), F.lit(1.0))) / 3.0
            return g.bound(p, lambda size: F.when(size > 0, b["q"] + 2.0 * size * F.cos(turn(size) + F.lit(2.0943951023931953))).otherwise(b["q"]))

        return g.bound(F.struct(q.alias("q"), *((s[k * 2] - q).alias(k) for k in "xyz")), of)

    def across(s: Column, low: Column) -> Column:
        """The longest product of two rows of the matrix less the eigenvalue, which is at right angles to all of them."""
        row = lambda i, j, k: F.struct(i.alias("x"), j.alias("y"), k.alias("z"))
        rows = F.array(row(s["xx"] - low, s["xy"], s["xz"]), row(s["xy"], s["yy"] - low, s["yz"]), row(s["xz"], s["yz"], s["zz"] - low))

        def longest(r: Column) -> Column:
            products = F.array(*(cross(F.get(r, F.lit(i)), F.get(r, F.lit(j))) for i, j in ((0, 1), (0, 2), (1, 2))))
            best = F.array_max(F.transform(products, lambda v: F.struct((v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]).alias("d"), v.alias("v"))))
            spread = s["xx"] + s["yy"] + s["zz"]
            return g.bound(best, lambda b: F.when(b["d"] > 1e-14 * spread * spread * spread * spread, F.struct(*((b["v"][c] / F.sqrt(b["d"])).alias(c) for c in "xyz"))))

        return g.bound(rows, longest)

    def sided(n: Column, v: Column) -> Column:
        away = F.coalesce(n["x"] * v["x"] + n["y"] * v["y"] + n["z"] * v["z"] < 0, F.lit(False))
        return F.struct(*(F.when(away, -n[c]).otherwise(n[c]).alias(c) for c in "xyz"))

    def own(r: Column, s: Column) -> Column:
        clear = lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]) > 1e-9 * (s["xx"] + s["yy"] + s["zz"])
        return g.bound(g.newell(r), lambda v: F.when(clear(v), unit(v)))

    def plane(r: Column, m: Column) -> Column:
        normal = g.bound(scatter(r, m), lambda s: g.bound(least(s), lambda low: F.coalesce(across(s, low), own(r, s))))
        return g.bound(normal, lambda n: F.when(n.isNotNull(), F.struct(m.alias("origin"), g.bound(g.newell(r), lambda v: sided(n, v)).alias("normal"))))

    return F.when(F.size(points) >= 3, g.bound(points, lambda r: g.bound(_mean(r), lambda m: plane(r, m))))


def away_from_plane(ring: Column, plane: Column) -> Column:
    """The largest distance of points from a plane (origin, normal)."""
    return F.array_max(F.transform(ring, lambda p: F.abs(_height(p, plane))))


def onto_plane(ring: Column, plane: Column) -> Column:
    """Points moved at right angles onto a plane (origin, normal)."""
    return F.transform(ring, lambda p: g.bound(_height(p, plane), lambda h: F.struct(*((p[c] - plane["normal"][c] * h).alias(c) for c in "xyz"))))


def _height(p: Column, plane: Column) -> Column:
    o, n = plane["origin"], plane["normal"]
    return (p["x"] - o["x"]) * n["x"] + (p["y"] - o["y"]) * n["y"] + (p["z"] - o["z"]) * n["z"]


def farthest_from_plane(ring: Column) -> Column:
    """The largest distance of a ring's points from the plane through its middle along its normal."""
    away = lambda r, n, c: F.array_max(F.transform(r, lambda p: F.abs(sum(((p[k] - c[k]) * n[k] for k in "yz"), (p["x"] - c["x"]) * n["x"]))))
    return g.bound(ring, lambda r: g.bound(unit(g.newell(r)), lambda n: g.bound(_mean(r), lambda c: away(r, n, c))))


def _mean(ring: Column) -> Column:
    total = lambda k: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(ring)
    return F.struct(*(total(k).alias(k) for k in "xyz"))


def _square(p: Column, q: Column) -> Column:
    return sum(((p[k] - q[k]) * (p[k] - q[k]) for k in "yz"), (p["x"] - q["x"]) * (p["x"] - q["x"]))


def faces(ring: Column, tolerance: float = 0.001) -> Column:
    """Corner numbers of the faces that stand for a ring without closing point.

    Three corners: a triangle. Four: a quad if flat, else two triangles along the shorter diagonal. More:
    one face if flat, else a fan. Fewer: none.
    """
    n = F.size(ring)
    flat = farthest_from_plane(ring) <= tolerance
    at = lambda i: F.get(ring, F.lit(i))
    ints = lambda *v: F.array(*map(F.lit, v))
    first = _square(at(0), at(2)) <= _square(at(1), at(3))
    whole = F.array(F.sequence(F.lit(0), n - 1))
    fan = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.array(F.lit(0), i, i + 1))
    none = F.expr("cast(array() as array<array<int>>)")
    return F.when(n < 3, none).when(n == 3, F.array(ints(0, 1, 2))).when(flat, whole).when(n == 4, F.when(first, F.array(ints(0, 1, 2), ints(0, 2, 3))).otherwise(F.array(ints(0, 1, 3), ints(1, 2, 3)))).otherwise(fan)


def without_collinear(ring: Column, tolerance: float = 0.001) -> Column:
    """A 2D ring (no closing point) without corners that lie within tolerance of the line between their neighbours; one pass."""
    n = F.size(ring)

    def keeps(p: Column, i: Column) -> Column:
        a, b = F.get(ring, (i + n - 1) % n), F.get(ring, (i + 1) % n)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        length = F.sqrt(dx * dx + dy * dy)
        return F.abs(dx * (p["y"] - a["y"]) - dy * (p["x"] - a["x"])) > tolerance * length

    return F.when(n > 3, F.filter(ring, keeps)).otherwise(ring)


def placed_line(line: Column, source: str, target: str, start: Column) -> Column:
    """A polyline in another system, moved by the origin; null if any of its points has no image."""
    images = F.transform(line, lambda p: srs.transform_xy(source, target, p["x"], p["y"]))
    moved = F.transform(images, lambda q: F.when(q.isNotNull() & ~F.isnan(q["x"]) & ~F.isnan(q["y"]), F.struct((q["x"] - start["x"]).alias("x"), (q["y"] - start["y"]).alias("y"))))
    return F.when(~F.exists(moved, lambda p: p.isNull()), moved)


def by_boxes(p: Column, source: Column, target: Column) -> Column:
    """A point moved from one box to the other in proportion, for systems without a projection; null for a flat box."""
    w, h = source["max_x"] - source["min_x"], source["max_y"] - source["min_y"]
    good = (F.abs(w) > 1e-12) & (F.abs(h) > 1e-12)
    x = target["min_x"] + (p["x"] - source["min_x"]) / w * (target["max_x"] - target["min_x"])
    y = target["min_y"] + (p["y"] - source["min_y"]) / h * (target["max_y"] - target["min_y"])
    return F.when(good, F.struct(x.alias("x"), y.alias("y")))


def image_quad(box: Column, z: Column) -> Column:
    """The four corners of an image over a box, counter-clockwise from the lower left, with texture coordinates."""
    corner = lambda x, y, u, v: F.struct(x.alias("x"), y.alias("y"), z.alias("z"), F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v"))
    return F.array(corner(box["min_x"], box["min_y"], 0, 0), corner(box["max_x"], box["min_y"], 1, 0), corner(box["max_x"], box["max_y"], 1, 1), corner(box["min_x"], box["max_y"], 0, 1))


def is_transient(status: Column, message: Column) -> Column:
    """Whether a failed request is worth another try: no status, 5xx, 408, 429, or a message that says so."""
    said = F.coalesce(F.lower(message).rlike(r"\b(408|429|500|502|503|504)\b|timeout|timed out"), F.lit(False))
    return status.isNull() | (status >= 500) | status.isin(408, 429) | said


def resolved_source(own: Column, default: Column, fallback: Column) -> Column:
    """struct<url,tier>: the user's address, the built-in one, or the fallback, the first that isn't blank."""
    given = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.when(given(own), F.struct(F.trim(own).alias("url"), F.lit("user").alias("tier"))).when(given(default), F.struct(default.alias("url"), F.lit("built-in").alias("tier"))).otherwise(F.struct(fallback.alias("url"), F.lit("fallback").alias("tier")))


def context_key(srs_name: Column, box: Column) -> Column:
    """A cache key of a context: the system and the box to six decimals."""
    return F.concat_ws("|", srs_name, *(F.format_string("%.6f", box[c]) for c in ("min_x", "min_y", "max_x", "max_y")))


def request_srs(names: Column, default: Column) -> Column:
    """The system to ask for: one with heights, else the geographic one, else the default."""
    normal = F.transform(names, lambda n: srs.normalize(n))
    return F.when(F.array_contains(normal, "EPSG:7423"), "EPSG:7423").when(F.array_contains(normal, "EPSG:4326"), "EPSG:4326").otherwise(F.coalesce(F.nullif(srs.normalize(default), F.lit("")), F.lit(srs.DEFAULT)))


def chosen_coverage(requests: DataFrame, catalog: DataFrame, service: str, wanted: str, name: str, order: str) -> DataFrame:
    """requests with coverage: the wanted one if its service has it, else the service's first; null without any."""
    names = catalog.select(F.col(service), F.col(name).alias("_n")).distinct()
    first = catalog.groupBy(service).agg(F.min_by(name, F.col(order)).alias("_first"))
    met = requests.join(names, (requests[service] == names[service]) & (F.col(wanted) == F.col("_n")), "left").drop(names[service]).join(first, service, "left")
    return met.withColumn("coverage", F.coalesce("_n", "_first")).drop("_n", "_first")
