"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014), each step cut from the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._cluster import cut, drop


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b) that differ; root is the component's least node.

    Any orderable type of node will do. Null ends, loops and repeated links have no effect; no links give an empty table.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, path = cut(edges, "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges, new = cut(small, "edges")
        drop(spark, path)
        path = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
