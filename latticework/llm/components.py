"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.session import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and component (the smallest node reachable) of each node in links (a, b: comparable ids).

    Alternates large-star and small-star steps: each node hands its neighbours on to the smallest one it sees, until
    all links point at their component's smallest node. Links are joined with one minimum a node, never gathered.
    """
    now = scratch.table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    step, before = 0, -1
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step += 1
        done = scratch.table(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        # a star forest: every node has one link, and no link's end has another below it
        shape = done.agg(F.count("*").alias("n"), F.count_distinct("a").alias("k"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        now = done
        if shape["h"] == before:
            break
        before = shape["h"]
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
