"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import common as C


def _are_stars(edges: DataFrame) -> bool:
    """Each ``a`` has one edge and is no ``b``: then ``b`` is the least node of the component. A row per node, counted before it is dealt out."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.agg(F.count_if(F.expr("up > 1 or up = 1 and down = 1"))).first()[0] == 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` (least node) for each node of the undirected edges ``a, b``; ends when all edges lead to a root."""
    edges = C.stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = edges.union(edges.select("b", "a"))
        low = C.stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = C.stored(large, name)
        low = C.stored(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = C.stored(small.union(low).distinct(), name)
        if _are_stars(edges):
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
