"""Connected components of links between integer identifiers, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.session import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.col("v") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every identifier in the links (a, b); the component is its smallest identifier.

    Every round joins edges to the smallest neighbour of their end, so no node's neighbours come together in one row, and
    is written to the shared folder; the rounds grow with the logarithm of the longest chain. Links from an identifier to
    itself and repeated links do no harm; no links give no rows.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = settle(small.where("u <> v").distinct(), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    found = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())
