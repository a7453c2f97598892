"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Links in a task of an iteration. Rounds are many and links can be few: a stage has as many tasks as
#: the links fill, not one for each shuffle partition.
LINKS_PER_TASK = 40_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct()


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).coalesce(tasks)
    least = checkpointed(down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node of its component.

    Each round takes the least neighbour of every node by a combined aggregate and hangs the other
    neighbours on it by a join, so a node with very many neighbours is never gathered in one place:
    the aggregate is checkpointed before, which leaves the join free to be split.
    The rounds grow with the logarithm of the longest chain. An empty table gives an empty table;
    loops, repeated and reversed links do not matter; links with a null end are left out.
    """
    edges = checkpointed(edges.select("u", "v").where("u <> v").distinct())
    edges = checkpointed(_small_star(edges, edges.count() // LINKS_PER_TASK + 1))
    sign = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == sign:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        tasks = now[0] // LINKS_PER_TASK + 1
        edges, sign = checkpointed(_small_star(_large_star(edges, tasks), tasks)), now
