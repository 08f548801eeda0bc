"""Connected components of a table of links, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table


def _minima(links: DataFrame) -> DataFrame:
    """Each node's smallest neighbour; aggregated before the shuffle, so a node with very many links costs no task much."""
    return links.groupBy("u").agg(F.min("v").alias("m"))


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) of every node that has a link. links: u, v of one type, no nulls.

    Large star: each node hands its larger neighbours to its smallest. Small star: each node hands itself
    and its smaller neighbours to the smallest. Links never multiply; rounds end when a round changes
    nothing, about log of the longest path. Every round is written to the shared folder.
    """
    pairs = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, last = write_table(pairs, "links"), None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minima(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        small = large.join(_minima(large), "u")
        pairs = write_table(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where(F.col("u") != F.col("v")).distinct(), "links")
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == last:
            roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = (state["n"], state["h"])
    raise RuntimeError(f"links still change after {most_rounds} rounds")
