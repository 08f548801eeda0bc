"""Text parsing and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?([0-9][0-9,]*)?[.]?[0-9]*([eE][+-]?[0-9]+)?\s*$"


def number(text: Column) -> Column:
    """A double from text that may have thousands separators; null for anything else (and for suffixes like '1f')."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.when(text.rlike(NUMBER) & text.rlike("[0-9]"), plain.try_cast("double"))


def positive_int(text: Column) -> Column:
    value = F.trim(text).try_cast("int")
    return F.when(value > 0, value)


def layer_name(label: Column) -> Column:
    """The name in 'name | title'."""
    return F.trim(F.element_at(F.split(label, r"\|", 2), 1))


def layer_label(name: Column, title: Column) -> Column:
    """'name | title', the name twice where the title is blank."""
    return F.concat_ws(" | ", name, F.coalesce(F.nullif(F.trim(title), F.lit("")), name))


def escape(text: Column) -> Column:
    """Percent-encoding that leaves only letters, digits and -_.~ as they are."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape(text: Column) -> Column:
    """Percent-decoding; '+' stays, malformed escapes leave the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def plain_double(x: Column) -> Column:
    """The shortest decimal form of a double without an exponent or a trailing '.0' (up to 15 significant digits)."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.12f", x), r"0+$", ""), r"\.$", "")


def bbox_text(box: Column, srs: Column | None = None) -> Column:
    """'minx,miny,maxx,maxy' and ',srs' where given."""
    parts = [plain_double(box[c]) for c in ("min_x", "min_y", "max_x", "max_y")]
    return F.concat_ws(",", *parts) if srs is None else F.concat_ws(",", *parts, escape(srs))


def bbox_parse(text: Column) -> Column:
    """struct<min_x,min_y,max_x,max_y> of four comma-separated numbers with min below max; null otherwise."""
    p = F.split(text, ",")
    v = [F.try_element_at(p, F.lit(i)).try_cast("double") for i in (1, 2, 3, 4)]
    good = (F.size(p) == 4) & v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull() & v[3].isNotNull() & (v[0] < v[2]) & (v[1] < v[3])
    return F.when(good, F.struct(*(x.alias(n) for x, n in zip(v, ("min_x", "min_y", "max_x", "max_y"), strict=True))))


def osm_length(text: Column) -> Column:
    """Metres of a tagged length: a foot mark or 'ft' anywhere means feet, a comma is a decimal point, the first number counts."""
    first = F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"[-+]?[0-9]+(?:[.][0-9]+)?", 0)
    value = F.nullif(first, F.lit("")).try_cast("double")
    feet = text.contains("'") | F.lower(text).contains("ft")
    return F.when(feet, value * F.lit(0.3048)).otherwise(value)


def osm_double(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def extension_of(mime: Column) -> Column:
    """File extension of an image or coverage type; '.bin' for others."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    return F.when(m.contains("png"), ".png").when(m.contains("jpeg") | m.contains("jpg"), ".jpg").when(m.contains("tif"), ".tif").when(m.contains("gif"), ".gif").otherwise(".bin")


def size_label(size: Column) -> Column:
    """Bytes, or whole KB, MB or GB rounded down."""
    out = None
    for unit, power in (("GB", 30), ("MB", 20), ("KB", 10)):
        step = F.lit(1 << power)
        out = (F.when if out is None else out.when)(size >= step, F.concat(F.floor(size / step).cast("long").cast("string"), F.lit(f" {unit}")))
    return out.otherwise(F.concat(size.cast("string"), F.lit(" B")))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many or one + "s")))


def query_parameters(query: Column) -> Column:
    """map of a query string: '+' is a space, percent escapes are decoded, keys keep their last value."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    entries = F.transform(parts, lambda p: F.struct(F.coalesce(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))), F.lit("")).alias("key"), F.coalesce(F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)), F.lit("")).alias("value")))
    last = entries
    keep = F.filter(F.transform(last, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: ~F.exists(F.slice(F.transform(last, lambda x: x["key"]), e["i"] + 2, F.size(last)), lambda k: k == e["key"]))
    return F.map_from_entries(F.transform(keep, lambda e: F.struct(e["key"], e["value"])))


def host_label(url: Column) -> Column:
    """The host of an absolute address; null for anything else."""
    return F.nullif(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def cache_file(url: Column, mime: Column) -> Column:
    """The name a downloaded image or coverage is kept under: its request's SHA-256 and the extension of its type."""
    return F.concat(F.sha2(url, 256), extension_of(mime))
