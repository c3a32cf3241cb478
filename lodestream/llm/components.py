"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import removed, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of the edges (a, b) the smallest node that it is connected with.

    Large-star and small-star steps in turn (Kiveris et al. 2014) until nothing changes, about as many as the logarithm
    of the longest path. Each step finds each node's smallest neighbour, combined before the shuffle, and joins it back.
    The hub of a large component has most of its edges: in the large-star step, where that counts, the minima are
    written first, so that the join shuffles both of its sides and Spark can split a hot node. Each result is written
    to the shared folder, and what came before it goes.
    """
    spark = edges.sparkSession
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(pairs: DataFrame, keep, join_root: bool) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        if not join_root:
            least = written(least, spark)
            done.append(least)
        linked = pairs.join(least, "a").where(keep)
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if join_root:  # the centre itself goes to the minimum too
            out = out.union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    # every edge points from the larger node to the smaller
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), spark)
    before, now = None, _mark(edges)
    done: list[DataFrame] = []
    while now != before and now[0]:
        done.append(edges)
        large = star(both(edges), F.col("b") > F.col("a"), False)
        edges = written(star(large, F.col("b") < F.col("a"), True), spark)
        while done:
            removed(done.pop())
        before, now = now, _mark(edges)
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
