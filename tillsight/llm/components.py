"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import written


def _hang(edges: DataFrame) -> DataFrame:
    """Small star, of edges with u > v: u and its neighbours hang on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    both = F.explode(F.array(F.struct(F.col("v").alias("x"), "m"), F.struct(F.col("u").alias("x"), "m"))).alias("e")
    return (edges.join(least, "u").select(both).select(F.col("e.x").alias("u"), F.col("e.m").alias("v"))
                 .where("u <> v").distinct())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) -> (node, component): the least node that can be reached, for every linked node.

    Each step is a partial minimum per node and a join; no neighbourhood is
    collected. The number of steps grows with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")))
    before = edges.agg(mark).first()[0]
    while True:
        # Large star: neighbours greater than a node hang on the least around it.
        turned = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        turned = turned.select("e.*")
        least = turned.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (turned.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = written(_hang(large.where("u <> v").distinct()), "edges")
        now = edges.agg(mark).first()[0]
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(roots)
