"""What a load asks for and falls back on: completed requests, formats to try, a required system, cached categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import context

# Versions and formats tried after JSON, and names that JSON goes by.
LATER_FORMATS = (("2.0.0", "application/gml+xml; version=3.2"), ("1.1.0", "text/xml; subtype=gml/3.1.1"))
JSON_NAMES = ("", "application/json", "json", "geojson")


def _given(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def completed(endpoint: Column, version: Column, offered_endpoint: Column, offered_version: Column) -> Column:
    """struct<endpoint,version>: a request with an endpoint stays as it is; else both are the service's where it tells them."""
    own = _given(endpoint)
    return F.struct(
        F.when(~own & _given(offered_endpoint), offered_endpoint).otherwise(endpoint).alias("endpoint"),
        F.when(~own & _given(offered_version), offered_version).otherwise(version).alias("version"),
    )


def formats_to_try(version: Column, output_format: Column) -> Column:
    """array of struct<version,format>: the asked one, then for JSON (or no format) the two of GML, none twice (case ignored)."""
    asked = F.array(F.struct(version.alias("version"), output_format.alias("format")))
    json = F.lower(F.trim(F.coalesce(output_format, F.lit("")))).isin(*JSON_NAMES)
    later = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(f).alias("format")) for v, f in LATER_FORMATS))
    fresh = F.filter(later, lambda x: ~F.coalesce((F.lower(x["version"]) == F.lower(version)) & (F.lower(x["format"]) == F.lower(output_format)), F.lit(False)))
    return F.when(json, F.concat(asked, fresh)).otherwise(asked)


def in_required_system(required: Column, boxes: Column, own: Column, request: Column, wgs84: Column) -> Column:
    """struct<srs,box,error> of a request to a source that serves one system only; without a required one the request as it is."""
    box = context.box_for(boxes, required, own, request, wgs84)
    message = F.concat(F.lit("The site has no box in "), required, F.lit("."))
    moved = F.struct(required.alias("srs"), box.alias("box"), F.when(box.isNull(), message).alias("error"))
    return F.when(_given(required), moved).otherwise(F.struct(own.alias("srs"), request.alias("box"), F.lit(None).cast("string").alias("error")))


def is_layer_name(layer: Column) -> Column:
    """False for text that is a service address rather than a layer's name."""
    upper = F.upper(layer)
    return ~F.coalesce(layer.contains("://") | upper.contains("REQUEST=GETCAPABILITIES") | upper.contains("SERVICE=WMS"), F.lit(False))


def any_wanted(wanted: dict[str, Column]) -> Column:
    """Whether at least one category is asked for."""
    return F.greatest(F.lit(False), *(F.coalesce(w, F.lit(False)) for w in wanted.values()))


def from_cache(failed: DataFrame, cached: DataFrame, key: str = "key", category: str = "category") -> DataFrame:
    """The cached elements (key, category and others) of failed batches; a batch whose category has none gives no row."""
    return cached.join(failed.select(key, category).distinct(), [key, category])
