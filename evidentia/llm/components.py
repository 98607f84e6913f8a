"""Connected components of an edge table by alternating stars, on the cluster throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import checkpointed

#: Edges that a task reads before more tasks share a round's reading.
EDGES = 200_000
#: A key that more than one row in so many has is hot; a table has no more hot keys than this (twice as many where both ends count).
HOT = 1024


def join_one(rows: DataFrame, one: DataFrame, key: str, total: int, weight: str) -> DataFrame:
    """Rows joined to the one row of their key in ``one``; rows of a hot key stay where they are.

    ``weight`` is the column of ``one`` that says how many of the ``total`` rows have its key, which the result leaves out.  Hot
    keys are fewer than HOT, so their side is broadcast whatever the size of the tables; the other keys are joined by shuffle.
    """
    more = [c for c in one.columns if c not in (key, weight)]
    hot = F.broadcast(one.where(F.col(weight) > total / HOT).select(key, F.struct(*more).alias("hot_row")))
    marked = rows.join(hot, key, "left")
    at_once = marked.where("hot_row IS NOT NULL").select(*rows.columns, *(F.col(f"hot_row.{c}").alias(c) for c in more))
    return at_once.unionByName(marked.where("hot_row IS NULL").drop("hot_row").join(one.drop(weight), key).select(*rows.columns, *more))


def dealt(edges: DataFrame, total: int) -> DataFrame:
    """The edges in as many tasks as their number asks for, and no fewer than there are cores: a shuffle can leave few edges in many partitions."""
    return edges.coalesce(max(edges.sparkSession.sparkContext.defaultParallelism, total // EDGES + 1))


def standing(edges: DataFrame) -> tuple[int, int]:
    """Number of different edges (u, v), u > v, and of the nodes that keep them from being stars: such as hang under several others, or under one and hold others."""
    end = lambda node, hangs: F.struct(F.col(node).alias("node"), F.lit(hangs).alias("hangs"))
    ends = edges.select(F.inline(F.array(end("u", 1), end("v", 0))))
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("over"), F.count_if(F.col("hangs") == 0).alias("under"))
    got = nodes.agg(F.coalesce(F.sum("over"), F.lit(0)).alias("total"), F.count_if((F.col("over") > 1) | ((F.col("over") > 0) & (F.col("under") > 0))).alias("loose")).first()
    return got["total"], got["loose"]


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Large stars hang each node's greater neighbours under the least of all its neighbours, small stars its smaller ones; rounds
    repeat until all that is left are stars, each checkpointed; edges that are stars need none.  Nodes of any comparable type; null ends, loops and repeated edges
    change nothing; an empty table gives an empty table.  Edges of a node with very many neighbours stay spread over the tasks.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        total, loose = standing(e)
        if not loose:
            break
        e = dealt(e, total)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        up = join_one(both.where("v > u"), least, "u", total, "n")
        large = dealt(checkpointed(up.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()), total)
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = join_one(large, down, "u", total, "n")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
