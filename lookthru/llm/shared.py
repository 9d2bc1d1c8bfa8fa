"""Helpers shared by the operators: stored intermediate tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lookthru.sources.kept import stored


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken or name + "_" in taken:
        name = "x_" + name
    return name


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or the node)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
    return _edges(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("low"))
    return _edges(down.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                  .unionByName(least.select("u", F.col("low").alias("v"))))


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the pairs; the component is its smallest node.

    Alternating stars (large, then small) until the edges stop changing; the number of rounds is
    logarithmic and each is a few joins. Nothing but one count and one sum per round reaches the driver.
    """
    edges = stored(_edges(pairs.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    mark = None
    while True:
        edges = stored(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    tied = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return tied.unionByName(tied.select(F.col("component").alias("node"), "component").distinct())
