"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hourlake.session import shared_dir


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) but the roots: root is the smallest node of its component.

    Each round hangs the larger neighbours of every node on its smallest one, then the node and its smaller
    neighbours likewise, until nothing changes: about log(nodes) rounds. A round is written to the
    shared folder, so no lineage grows and a lost executor repeats one round at most. Nodes are numbers; null
    ends are ignored.
    """
    spark, base = links.sparkSession, shared_dir(links.sparkSession, "components")
    links = links.where("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    links.distinct().write.parquet(f"{base}/0")
    before = None
    for k in range(rounds):
        now = spark.read.parquet(f"{base}/{k}")
        marks = F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))
        if (after := tuple(now.agg(*marks).first())) == before or not after[0]:
            return now
        before = after
        both = now.union(now.select(F.col("root"), F.col("node"))).toDF("x", "y")
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("low"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("low").alias("y")).distinct()
        lowest = large.groupBy("x").agg(F.min("y").alias("low"))
        small = large.join(lowest, "x")
        small = small.where("y > low").select("y", "low").union(small.select("x", "low")).toDF("node", "root")
        small.distinct().write.parquet(f"{base}/{k + 1}")
    raise RuntimeError(f"no fixpoint after {rounds} rounds")
