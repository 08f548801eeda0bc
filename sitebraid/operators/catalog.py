"""Catalogs of layers and coverages: distinct names, order, scores, preferred systems, inherited trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import srs

# What words in a layer's name and title count for.
IMAGERY_SCORES = ((("dop",), 100), (("ortho",), 80), (("rgb",), 40), (("image", "imagery"), 20), (("cir",), -20), (("info",), -60), (("alk",), -80), (("tk",), -20))
BUILDING_SCORES = ((("building",), 100), (("lod2",), 80), (("bu-core3d",), 50))


def distinct_first(df: DataFrame, name: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The first row (by order) of each name, case ignored (folded to upper case); blank and null names go.

    Aggregates before the shuffle, so a name that repeats very often costs no task much.
    """
    rows = df.where(F.trim(F.col(name)) != "").withColumn("_key", F.upper(name))
    row = F.struct(*df.columns)
    return rows.groupBy(*by, "_key").agg(F.min_by(row, F.col(order)).alias("_row")).select("_row.*")


def in_order(df: DataFrame, name: str, order: str) -> DataFrame:
    return df.orderBy(F.upper(name), order)


def score(name: Column, title: Column, scores: tuple) -> Column:
    text = F.lower(F.concat_ws(" ", name, title))
    out = F.lit(0)
    for words, points in scores:
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit | text.contains(w)
        out = out + F.when(hit, F.lit(points)).otherwise(F.lit(0))
    return out


def best_layer(df: DataFrame, by: tuple[str, ...], name: str, title: str, scores: tuple) -> DataFrame:
    """name and score of each group's best layer: highest score, then name in upper case, then name."""
    scored = df.select(*by, F.col(name).alias("name"), score(F.col(name), F.col(title), scores).alias("score"))
    best = scored.groupBy(*by).agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), F.upper("name"), F.col("name"))).alias("b"))
    return best.select(*by, "b.name", "b.score")


def best_srs(df: DataFrame, by: tuple[str, ...], text: str, order: str) -> DataFrame:
    """The preferred system of each group's names; of equals the first."""
    rows = df.select(*by, F.col(order).alias("_o"), srs.normalize(F.col(text)).alias("srs")).withColumn("rank", srs.rank(F.col("srs")))
    best = rows.groupBy(*by).agg(F.min_by(F.struct("srs", "rank"), F.struct(-F.col("rank"), F.col("_o"))).alias("b"))
    return best.select(*by, "b.srs", "b.rank")


def inherited(nodes: DataFrame) -> DataFrame:
    """node_id, name, srs_list of a layer tree (node_id, parent_id, name, srs): each layer's systems follow its parents', distinct.

    Each round joins every layer with the one that its list has come up to, so lists reach twice as far up as
    before: rounds grow with the logarithm of the depth, and no level of the tree meets in one task. Layers
    below a missing one are left out; a list that never ends is a cycle, which is an error.
    """
    none = F.expr("cast(array() as array<string>)")
    t = nodes.select("node_id", "name", F.col("parent_id").alias("up"), F.array_distinct(F.coalesce("srs", none)).alias("srs_list"))
    left = t.count().bit_length() + 1
    while not t.where("up is not null").isEmpty():
        if not left:
            raise ValueError("the layer tree has a cycle")
        above = t.select(F.col("node_id").alias("up"), F.col("up").alias("further"), F.col("srs_list").alias("above"))
        met = t.where("up is not null").join(above, "up").select("node_id", "name", F.col("further").alias("up"), F.array_distinct(F.concat("above", "srs_list")).alias("srs_list"))
        t, left = t.where("up is null").unionByName(met).persist(), left - 1
    return t.drop("up")


def requested_layers(df: DataFrame, label: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Names of requested labels ('name | title'), blank ones left out, each once (case ignored), first kept, with their place."""
    from ..functions.text import layer_name

    named = df.select(*by, F.col(order).alias("ordinal"), layer_name(F.col(label)).alias("name"))
    kept = distinct_first(named, "name", "ordinal", by)
    return kept.withColumn("layer_index", F.row_number().over(W.partitionBy(*by).orderBy("ordinal")) - 1)
