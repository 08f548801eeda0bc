"""Payload tables (path or id, payload text) to typed rows: JSON with native functions, XML by a walk in mapInPandas.

A payload that can't be read fails the load (mode 'failfast') or gives no rows ('permissive').
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

POINT = "struct<x:double,y:double>"
GEOMETRY = f"struct<type:string,outer_rings:array<array<{POINT}>>,line_strings:array<array<{POINT}>>,points:array<{POINT}>>"
FEATURES = "features array<struct<id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def kind(payload: Column) -> Column:
    """'geojson', 'xml' or 'unsupported', by the first character that isn't white space."""
    return F.when(payload.rlike(r"^\s*[{\[]"), "geojson").when(payload.rlike(r"^\s*<"), "xml").otherwise("unsupported")


def _points(coordinates: Column) -> Column:
    """array<array<double>> as points; positions of fewer than two ordinates are left out."""
    return F.transform(F.filter(coordinates, lambda c: (F.size(c) >= 2) & F.get(c, F.lit(0)).isNotNull() & F.get(c, F.lit(1)).isNotNull()), lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))


def geometry(kind_: Column, coordinates: Column) -> Column:
    """The six geometry types; polygons keep their outer rings. Null type: 'Null'; without coordinates: the type only."""
    parsed = lambda depth: F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)
    no_points, no_lines = F.expr(f"cast(array() as array<{POINT}>)"), F.expr(f"cast(array() as array<array<{POINT}>>)")

    def made(rings: Column | None = None, lines: Column | None = None, points: Column | None = None) -> Column:
        none = lambda c, e: e if c is None else F.coalesce(c, e)
        return F.struct(kind_.alias("type"), none(rings, no_lines).alias("outer_rings"), none(lines, no_lines).alias("line_strings"), none(points, no_points).alias("points"))

    single = parsed(1)
    point = F.when(F.size(single) >= 2, F.array(F.struct(F.get(single, F.lit(0)).alias("x"), F.get(single, F.lit(1)).alias("y")))).when(single.isNotNull(), F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))))
    null = F.struct(F.lit("Null").alias("type"), no_lines.alias("outer_rings"), no_lines.alias("line_strings"), no_points.alias("points"))
    return (
        F.when(kind_.isNull(), null)
        .when(kind_ == "Point", made(points=point))
        .when(kind_ == "MultiPoint", made(points=_points(parsed(2))))
        .when(kind_ == "LineString", made(lines=F.when(F.size(parsed(2)) > 0, F.array(_points(parsed(2))))))
        .when(kind_ == "MultiLineString", made(lines=F.transform(parsed(3), _points)))
        .when(kind_ == "Polygon", made(rings=F.when(F.size(parsed(3)) > 0, F.array(_points(F.get(parsed(3), F.lit(0)))))))
        .when(kind_ == "MultiPolygon", made(rings=F.transform(F.filter(parsed(4), lambda p: F.size(p) > 0), lambda p: _points(F.get(p, F.lit(0))))))
        .otherwise(F.raise_error(F.concat(F.lit("Unsupported geometry type: "), kind_)).cast(GEOMETRY))
    )


def attributes(properties: Column) -> Column:
    """Properties with keys that differ only in case made one: the first spelling, the last value."""
    entries = F.transform(F.map_entries(F.coalesce(properties, F.expr("cast(map() as map<string,string>)"))), lambda e, i: F.struct(F.upper(e["key"]).alias("u"), e["key"].alias("key"), e["value"].alias("value"), i.alias("i")))
    first = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["u"] == e["u"]) & (o["i"] < e["i"])))
    return F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"], F.element_at(F.filter(entries, lambda o: o["u"] == e["u"]), -1)["value"])))


def geojson(payloads: DataFrame, payload: str = "payload", layer: str = "layer", mode: str = "failfast") -> DataFrame:
    """source_layer, seq, id, geometry, attributes of feature collections, in their order."""
    options = {"mode": "FAILFAST" if mode == "failfast" else "PERMISSIVE"}
    rows = payloads.select(F.col(layer).alias("source_layer"), F.from_json(F.col(payload), FEATURES, options).alias("c"))
    rows = rows.select("source_layer", F.posexplode("c.features").alias("seq", "f"))
    return rows.select("source_layer", "seq", "f.id", geometry(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("geometry"), attributes(F.col("f.properties")).alias("attributes"))


OSM = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,members:array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>>>"


def osm_elements(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """seq, type, id, tags, line (points), ring (closed, four points at least), members of tagged elements."""
    rows = payloads.select(F.from_json(F.col(payload), OSM).alias("c")).select(F.posexplode("c.elements").alias("seq", "e")).select("seq", "e.*")
    line = F.transform(F.filter(F.coalesce("geometry", F.expr("cast(array() as array<struct<lat:double,lon:double>>)")), lambda p: p.isNotNull()), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    closed = g.close(line)
    return rows.select("seq", "type", "id", F.coalesce("tags", F.expr("cast(map() as map<string,string>)")).alias("tags"), F.when(F.size(line) >= 2, line).alias("line"), F.when(F.size(closed) >= 4, closed).alias("ring"), "members")


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _child_text(element: ET.Element, *names: str) -> str:
    for name in names:
        for c in element:
            if _name(c) == name and (c.text or "").strip():
                return c.text.strip()
    return ""


def _parsed(text: str | None, mode: str) -> ET.Element | None:
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        if mode == "failfast":
            raise ValueError("the payload is not XML") from None
        return None
    if "Exception" in _name(root):
        message = next((e.text.strip() for e in root.iter() if _name(e) in ("ExceptionText", "ServiceException") and (e.text or "").strip()), "the service reported an error")
        if mode == "failfast":
            raise ValueError(message)
        return None
    return root


def _numbers(text: str) -> list[float | None]:
    out = []
    for t in text.split():
        try:
            out.append(float(t.replace(",", "")))
        except ValueError:
            out.append(None)
    return out


def _positions(element: ET.Element, srs: str, dimension: int | None) -> list[tuple[float, float, float]]:
    """Points of posList, pos or coordinates below a geometry element, in order."""
    out: list[tuple[float, float, float]] = []
    for e in element.iter():
        d = e.get("srsDimension")
        d = int(d) if d and d.isdigit() else dimension
        name = _name(e)
        if name == "posList" or name == "pos":
            v = _numbers(e.text or "")
            step = d or (3 if any(c in srs for c in ("7423", "4979")) and len(v) % 3 == 0 else 2) if name == "posList" else max(2, len(v))
            out += [(v[i], v[i + 1], (v[i + 2] or 0.0) if step >= 3 and i + 2 < len(v) else 0.0) for i in range(0, len(v) - 1, step) if v[i] is not None and v[i + 1] is not None]
        elif name == "coordinates":
            for pair in (e.text or "").split():
                v = _numbers(pair.replace(",", " "))
                if len(v) >= 2 and None not in v[:2]:
                    out.append((v[0], v[1], (v[2] or 0.0) if len(v) > 2 else 0.0))
    return [(y, x, z) if "EPSG" in srs.upper() and abs(x) >= 1e6 > abs(y) else (x, y, z) for x, y, z in out]


_GML_KINDS = {"point": "Point", "linestring": "LineString", "curve": "LineString", "polygon": "Polygon", "surface": "Polygon", "multipoint": "MultiPoint", "multilinestring": "MultiLineString", "multicurve": "MultiLineString", "multipolygon": "MultiPolygon", "multisurface": "MultiPolygon"}
XML_ROWS = "source_layer string, seq int, id string, type string, part int, role string, points array<struct<x:double,y:double>>, attributes map<string,string>"


def gml(payloads: DataFrame, payload: str = "payload", layer: str = "layer", mode: str = "failfast") -> DataFrame:
    """A row a geometry part of feature collections: ring, line or point list, with the feature's attributes.

    Members are read by local names, whatever the namespace; a polygon gives its outer ring; system names
    are inherited from the nearest element above.
    """

    def parts(node: ET.Element, srs: str):
        name = _name(node).lower()
        srs = node.get("srsName") or srs
        d = node.get("srsDimension")
        d = int(d) if d and d.isdigit() else None
        if name in ("polygon", "polygonpatch"):
            ring = next((e for e in node.iter() if _name(e) == "LinearRing"), None)
            yield "ring", _positions(ring, srs, d) if ring is not None else []
        elif name in ("linestring", "linestringsegment"):
            yield "line", _positions(node, srs, d)
        elif name == "point":
            yield "point", _positions(node, srs, d)[:1] or [(0.0, 0.0, 0.0)]
        else:
            for c in node:
                yield from parts(c, srs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, text in zip(batch["layer"], batch["payload"], strict=True):
                root = _parsed(text, mode)
                members = [m for m in root.iter() if _name(m) in ("member", "featureMember")] if root is not None else []
                for seq, member in enumerate(members):
                    feature = next(iter(member), None)
                    if feature is None:
                        continue
                    ident = next((v for k, v in feature.attrib.items() if k.rpartition("}")[2] in ("id", "fid")), None)
                    plain = {_name(c): (c.text or "").strip() for c in feature if not len(c)}
                    shape = next((e for e in feature.iter() if _name(e).lower() in _GML_KINDS), None)
                    kind_ = _GML_KINDS[_name(shape).lower()] if shape is not None else "Null"
                    found = list(parts(shape, root.get("srsName") or "")) if shape is not None else [("none", [])]
                    for i, (role, points) in enumerate(found):
                        out.append((name, seq, ident, kind_, i, role, [{"x": x, "y": y} for x, y, _ in points], plain))
            yield pd.DataFrame(out, columns=["source_layer", "seq", "id", "type", "part", "role", "points", "attributes"])

    return payloads.select(F.col(layer).alias("layer"), F.col(payload).alias("payload")).mapInPandas(run, XML_ROWS)


RINGS = "source_layer string, building int, id string, surface int, ring int, outer boolean, points array<struct<x:double,y:double,z:double>>, attributes map<string,string>"


def lod2(payloads: DataFrame, payload: str = "payload", layer: str = "layer", mode: str = "failfast") -> DataFrame:
    """A row a ring of building surfaces; buildings without a surface give none. Rings keep four points or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, text in zip(batch["layer"], batch["payload"], strict=True):
                root = _parsed(text, mode)
                buildings = [b for b in root.iter() if _name(b) in ("Building", "BuildingPart")] if root is not None else []
                for k, b in enumerate(buildings):
                    ident = next((v for a, v in b.attrib.items() if a.rpartition("}")[2] == "id"), None)
                    facts = {n: t for n, t in (("Identifier", _child_text(b, "identifier")), ("LocalId", next((e.text for e in b.iter() if _name(e) == "localId" and e.text), "")), ("HeightAboveGround", next((_child_text(e, "value") or "".join(_child_text(c, "value") for c in e) for e in b.iter() if _name(e) == "HeightAboveGround"), ""))) if t}
                    srs = next((e.get("srsName") for e in b.iter() if e.get("srsName")), root.get("srsName") or "")
                    n = 0
                    for polygon in (e for e in b.iter() if _name(e) in ("Polygon", "PolygonPatch")):
                        rings = [(side, _positions(side, srs, None)) for side in polygon if _name(side) in ("exterior", "interior")]
                        outer = next((p for s, p in rings if _name(s) == "exterior" and len(p) >= 4), None)
                        if outer is None:
                            continue
                        kept = [(True, outer)] + [(False, p) for s, p in rings if _name(s) == "interior" and len(p) >= 4]
                        out += [(name, k, ident, n, i, is_outer, [{"x": x, "y": y, "z": z} for x, y, z in p], facts) for i, (is_outer, p) in enumerate(kept)]
                        n += 1
            yield pd.DataFrame(out, columns=["source_layer", "building", "id", "surface", "ring", "outer", "points", "attributes"])

    return payloads.select(F.col(layer).alias("layer"), F.col(payload).alias("payload")).mapInPandas(run, RINGS)


LAYERS = "service string, seq int, node_id string, parent_id string, name string, title string, srs array<string>, box struct<min_x:double,min_y:double,max_x:double,max_y:double>, version string, get_url string"


def capabilities(payloads: DataFrame, payload: str = "payload", mode: str = "failfast") -> DataFrame:
    """A row a layer, feature type or named coverage of service descriptions, with the tree's links and the request address."""

    def box(node: ET.Element):
        for e in node:
            name = _name(e)
            if name in ("WGS84BoundingBox", "EX_GeographicBoundingBox", "LatLonBoundingBox"):
                low, high = _numbers(_child_text(e, "LowerCorner")), _numbers(_child_text(e, "UpperCorner"))
                v = low + high if low and high else [*map(lambda n: (_numbers(_child_text(e, n)) or [None])[0], ("westBoundLongitude", "southBoundLatitude", "eastBoundLongitude", "northBoundLatitude"))]
                if None in v:
                    v = [(_numbers(e.get(a) or "") or [None])[0] for a in ("minx", "miny", "maxx", "maxy")]
                if len(v) == 4 and None not in v:
                    return dict(zip(("min_x", "min_y", "max_x", "max_y"), v, strict=True))
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["payload"]:
                root = _parsed(text, mode)
                if root is None:
                    continue
                service = {"FeatureType": "wfs", "Layer": "wms", "CoverageSummary": "wcs"}
                operation = next((o for o in root.iter() if _name(o) == "Operation" and o.get("name") in ("GetFeature", "GetCoverage") or _name(o) == "GetMap"), None)
                address = None
                if operation is not None:
                    get = next((e for e in operation.iter() if _name(e) == "Get"), operation)
                    address = next((v for e in get.iter() for a, v in e.attrib.items() if a.rpartition("}")[2] == "href"), None)
                above = {c: p for p in root.iter() for c in p}
                nodes = [e for e in root.iter() if _name(e) in service]
                numbers = {e: str(i) for i, e in enumerate(nodes)}
                for i, e in enumerate(nodes):
                    name = _child_text(e, "CoverageId", "Identifier") if _name(e) == "CoverageSummary" else _child_text(e, "Name")
                    if _name(e) == "CoverageSummary" and not name:
                        continue
                    systems = [t for c in e if _name(c) in ("DefaultSRS", "DefaultCRS", "OtherSRS", "OtherCRS", "SRS", "CRS") and c.text for t in c.text.split()]
                    parent = above.get(e)
                    out.append((service[_name(e)], i, numbers[e], numbers.get(parent), name or None, _child_text(e, "Title") or name or None, list(dict.fromkeys(systems)), box(e), root.get("version"), address))
            yield pd.DataFrame(out, columns=["service", "seq", "node_id", "parent_id", "name", "title", "srs", "box", "version", "get_url"])

    return payloads.select(F.col(payload).alias("payload")).mapInPandas(run, LAYERS)


def coverage_description(payload: Column) -> Column:
    """struct<coverage_id,srs,box,axis_x,axis_y,origin,offset_x,offset_y,nodata> of a coverage's description.

    Elements are found by local name at any depth. Without an envelope the load fails; without an origin it is
    the envelope's upper left corner; offsets default to one east and one south.
    """
    at = lambda path: F.nullif(F.trim(F.xpath_string(payload, F.lit(path))), F.lit(""))
    element = lambda *names: "//*[" + " or ".join(f"local-name()='{n}'" for n in names) + "]"
    first = lambda *names: f"({element(*names)})[1]"
    pair = lambda text: F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), lambda t: t.try_cast("double"))
    envelope = first("Envelope")
    low, high = (pair(at(f"{envelope}/*[local-name()='{c}']")) for c in ("lowerCorner", "upperCorner"))
    point = lambda v, x, y: F.struct(F.coalesce(F.get(v, F.lit(0)), x).alias("x"), F.coalesce(F.get(v, F.lit(1)), y).alias("y"))
    labels = F.filter(F.split(at(f"{envelope}/@axisLabels"), r"\s+"), lambda t: t != "")
    offset = lambda i: pair(at(f"({element('offsetVector')})[{i}]"))
    box = F.struct(F.get(low, F.lit(0)).alias("min_x"), F.get(low, F.lit(1)).alias("min_y"), F.get(high, F.lit(0)).alias("max_x"), F.get(high, F.lit(1)).alias("max_y"))
    made = F.struct(
        F.coalesce(at(first("CoverageId", "Identifier")), F.lit("")).alias("coverage_id"),
        F.coalesce(at(f"{envelope}/@srsName"), F.lit("")).alias("srs"),
        box.alias("box"),
        F.coalesce(F.get(labels, F.lit(0)), F.lit("x")).alias("axis_x"),
        F.coalesce(F.get(labels, F.lit(1)), F.lit("y")).alias("axis_y"),
        point(pair(at(f"{first('origin')}//*[local-name()='pos']")), box["min_x"], box["max_y"]).alias("origin"),
        point(offset(1), F.lit(1.0), F.lit(0.0)).alias("offset_x"),
        point(offset(2), F.lit(0.0), F.lit(-1.0)).alias("offset_y"),
        at(first("nilValue", "NoData", "nodata")).try_cast("double").alias("nodata"),
    )
    return F.when(F.xpath_boolean(payload, F.lit(envelope)), made).otherwise(F.raise_error(F.lit("The coverage description has no envelope.")).cast(DESCRIPTION))


DESCRIPTION = "struct<coverage_id:string,srs:string,box:struct<min_x:double,min_y:double,max_x:double,max_y:double>,axis_x:string,axis_y:string,origin:struct<x:double,y:double>,offset_x:struct<x:double,y:double>,offset_y:struct<x:double,y:double>,nodata:double>"
