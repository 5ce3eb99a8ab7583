"""Connected components of a graph that is too large for one machine.

Alternating star contraction (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014): every node learns the least of its neighbours, and edges move towards it, until each
component is a star around its least node. Only aggregations with partial sums and joins that
Spark may split are used, so a hub with very many edges does not end in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import erase, opaque, written


def _with_least(pairs: DataFrame) -> DataFrame:
    """u, v and the least neighbour of u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select(opaque("u").alias("_u"), "least")
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", "least")


def _round(edges: DataFrame) -> DataFrame:
    """edges: u > v. One large-star step and one small-star step."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v")).distinct()
    small = _with_least(large).select(F.explode(F.array(F.struct("v", "least"), F.struct(F.col("u").alias("v"), "least"))).alias("e"))
    return small.select(F.col("e.v").alias("u"), F.col("e.least").alias("v")).filter("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: two long columns without nulls, in any direction, repeated or not.

    Returns node, component (the least node that it reaches) for every node but those that are
    the least of theirs. No edges: no rows. Rounds grow with the logarithm of the longest shortest path, so 60 are far
    more than any graph needs that fits on disks; the table of a round is deleted when the next one is written.
    """
    a, b = edges.columns
    now = written(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = digest(now)
    if not was[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        before, now = now, written(_round(now))
        new = digest(now)
        erase(before)
        if new == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        was = new
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")
