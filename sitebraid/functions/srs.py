"""Coordinate reference systems as column expressions: names, ranks, projections. Everything stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recognised codes in the order they are looked for, and how far each is preferred.
CODES = ("25832", "25833", "27700", "3857", "7844", "4283", "4326", "7423")
RANKS = {"25832": 100, "25833": 95, "27700": 90, "3857": 70, "7844": 40, "4283": 35, "4326": 10, "7423": 5}
GEOGRAPHIC = ("4326", "7423", "4283", "7844")
DEFAULT = "EPSG:25832"
#: WGS84 ellipsoid; UTM's scale and false easting.
AXIS, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def normalize(text: Column, other: str = "upper") -> Column:
    """'EPSG:<code>' for a text that names a recognised code anywhere; else the text in upper case, trimmed, or empty.

    other: what becomes of an unrecognised text ('upper', 'trim' or 'empty'). Null and blank give ''.
    """
    rest = {"upper": F.upper(F.trim(text)), "trim": F.trim(text), "empty": F.lit("")}[other]
    out = F.when(text.isNull() | (F.trim(text) == ""), F.lit(""))
    for code in CODES:
        out = out.when(text.contains(code), F.lit(f"EPSG:{code}"))
    return out.otherwise(rest)


def rank(srs: Column) -> Column:
    """How far a normalised name is preferred; 0 for an unknown one."""
    out = None
    for code, r in RANKS.items():
        out = (F.when if out is None else out.when)(srs == f"EPSG:{code}", F.lit(r))
    return out.otherwise(F.lit(0))


def is_geographic(srs: Column) -> Column:
    return srs.isin(*(f"EPSG:{c}" for c in GEOGRAPHIC))


def _d(x: float) -> Column:
    return F.lit(float(x))


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres of degrees."""
    x = lon * _d(AXIS * math.pi / 180)
    y = F.log(F.tan(_d(math.pi / 4) + lat * _d(math.pi / 360))) * _d(AXIS)
    return x, y


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    lon = x / _d(AXIS * math.pi / 180)
    lat = (F.atan(F.exp(y / _d(AXIS))) * _d(2.0) - _d(math.pi / 2)) * _d(180 / math.pi)
    return lon, lat


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Transverse Mercator metres of degrees by the published series to the sixth power (about a millimetre inside a zone)."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    phi = lat * _d(math.pi / 180)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = _d(AXIS) / F.sqrt(_d(1.0) - _d(e2) * sin * sin)
    t, c = tan * tan, _d(ep2) * cos * cos
    a = (lon - _d(6.0 * zone - 183.0)) * _d(math.pi / 180) * cos
    m = _d(AXIS) * (
        _d(1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - _d(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(_d(2.0) * phi)
        + _d(15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(_d(4.0) * phi)
        - _d(35 * e2**3 / 3072) * F.sin(_d(6.0) * phi)
    )
    a2 = a * a
    x = _d(SCALE) * n * (a + (_d(1.0) - t + c) * a2 * a / _d(6.0) + (_d(5.0) - _d(18.0) * t + t * t + _d(72.0) * c - _d(58 * ep2)) * a2 * a2 * a / _d(120.0)) + _d(EASTING)
    y = _d(SCALE) * (m + n * tan * (a2 / _d(2.0) + (_d(5.0) - t + _d(9.0) * c + _d(4.0) * c * c) * a2 * a2 / _d(24.0) + (_d(61.0) - _d(58.0) * t + t * t + _d(600.0) * c - _d(330 * ep2)) * a2 * a2 * a2 / _d(720.0)))
    return x, y


def from_utm(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """Degrees of transverse Mercator metres (northern half)."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep2, e1 = e2 / (1 - e2), (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = y / _d(SCALE * AXIS * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    p = mu + _d(3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(_d(2.0) * mu) + _d(21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(_d(4.0) * mu) + _d(151 * e1**3 / 96) * F.sin(_d(6.0) * mu) + _d(1097 * e1**4 / 512) * F.sin(_d(8.0) * mu)
    sin, cos, tan = F.sin(p), F.cos(p), F.tan(p)
    w = _d(1.0) - _d(e2) * sin * sin
    n, r = _d(AXIS) / F.sqrt(w), _d(AXIS * (1 - e2)) / (w * F.sqrt(w))
    t, c = tan * tan, _d(ep2) * cos * cos
    d = (x - _d(EASTING)) / (n * _d(SCALE))
    d2 = d * d
    lat = p - n * tan / r * (d2 / _d(2.0) - (_d(5.0) + _d(3.0) * t + _d(10.0) * c - _d(4.0) * c * c - _d(9 * ep2)) * d2 * d2 / _d(24.0) + (_d(61.0) + _d(90.0) * t + _d(298.0) * c + _d(45.0) * t * t - _d(252 * ep2) - _d(3.0) * c * c) * d2 * d2 * d2 / _d(720.0))
    lon = (d - (_d(1.0) + _d(2.0) * t + c) * d2 * d / _d(6.0) + (_d(5.0) - _d(2.0) * c + _d(28.0) * t - _d(3.0) * c * c + _d(8 * ep2) + _d(24.0) * t * t) * d2 * d2 * d / _d(120.0)) / cos
    return lon * _d(180 / math.pi) + _d(6.0 * zone - 183.0), lat * _d(180 / math.pi)


def transform_xy(source: str, target: str, x: Column, y: Column) -> Column:
    """struct<x,y> in the target system; the input where both are the same, null where one has no projection here."""
    if source == target:
        return F.struct(x.alias("x"), y.alias("y"))
    known = {*(f"EPSG:{c}" for c in GEOGRAPHIC), "EPSG:3857", "EPSG:25832", "EPSG:25833"}
    if source not in known or target not in known:
        return F.lit(None).cast("struct<x:double,y:double>")
    lon, lat = (x, y) if source[5:] in GEOGRAPHIC else from_web_mercator(x, y) if source == "EPSG:3857" else from_utm(x, y, int(source[-2:]))
    px, py = (lon, lat) if target[5:] in GEOGRAPHIC else to_web_mercator(lon, lat) if target == "EPSG:3857" else to_utm(lon, lat, int(target[-2:]))
    return F.struct(px.alias("x"), py.alias("y"))


def whole(x: Column, scale: float = 1000.0) -> Column:
    """A coordinate as an integer of the given fraction, half up; the same in every engine."""
    return F.floor(x * _d(scale) + _d(0.5)).cast("long")
