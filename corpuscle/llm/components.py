"""Connected components of a graph given as pairs, by alternating stars.

A round joins every node's larger neighbours to its least neighbour (large star),
then its smaller neighbours to the least of them (small star), until nothing
changes; what is left is a star about the least node of each component.  A hot
node's neighbours are spread by salt.  Each round is a written table, so that no
lineage grows, and only a count and a checksum reach the driver; tables of earlier
rounds are deleted.

Pairs of a node with itself and pairs with a null are left out; repeated pairs and
pairs in either order count once.  An empty table gives an empty result.  Columns
beside a and b are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, salted_join


def components(pairs: DataFrame) -> DataFrame:
    """node and component (its least node) of every node that occurs in (a, b)."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    edges = cut(pairs.where("a <> b").select(hi.alias("a"), lo.alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), least, "u", "v").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = cut(large.distinct(), "large")  # each a has few smaller neighbours now
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, edges = edges, cut(small.distinct(), "small")
        discard(before, large)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
