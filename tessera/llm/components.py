"""Connected components of a distributed edge list by alternating star contraction; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


#: Parts that the edges of one node are dealt to.
PARTS = 32


def _with_least(edges: DataFrame, least_of: Column) -> DataFrame:
    """edges (a, b) with m, the least of each a's group. A hub's edges are dealt to PARTS tasks, each of which gets the hub's m: the
    sides of the join that carries it hold a row per node and part, so no key is hot."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    parts = dealt.groupBy("a", "part").agg(F.min("b").alias("m"))
    whole = parts.groupBy("a").agg(F.min("m").alias("b")).select("a", least_of.alias("m"))
    return dealt.join(parts.select("a", "part").join(whole, "a"), ["a", "part"]).select("a", "b", "m")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) edges of any ordered type -> (node, component), component the smallest node that can be reached.

    Large-star and small-star alternate (Kiveris et al. 2014) until every edge points at a smallest node. Each round is
    two shuffles of at most as many edges as there were; rounds grow with the logarithm of the longest path.
    """
    cur = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        both = cur.union(cur.select("b", "a").toDF("a", "b"))
        large = _with_least(both, F.least("a", "b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _with_least(down, F.col("b"))
        # every neighbour and the node itself point at the least neighbour
        nxt = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        nxt = materialize(nxt, "edges")
        n, s = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = nxt
        if (n, s) == last:
            break
        last = (n, s)
    else:
        raise RuntimeError("components did not settle")
    star = cur.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = star.select("component").distinct().select(F.col("component").alias("node"), "component")
    return star.union(roots)
