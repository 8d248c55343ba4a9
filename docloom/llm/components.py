"""Connected components of links that may not fit one machine: alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import Workspace


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links u, v.

    A large star hands a node's larger neighbours to its least one, a small star the smaller ones; both keep the
    components, and the links end as one star for each. Rounds grow with the logarithm of the number of nodes.
    """
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    work = Workspace(edges.sparkSession)
    now = work.written(edges.where("u != v").select(*pair).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = work.written(small.where("u != v").distinct(), "links")
        mark, before = _mark(after), mark
        work.clear(now)
        now = after
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
