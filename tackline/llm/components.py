"""Connected components by alternating star operations.

Each round joins edges with the smallest neighbour of their ends, first among
all neighbours, then among smaller ones. Edges stay distinct pairs, a round
shuffles them a bounded number of times, and no vertex's neighbours are ever
gathered in one place: hubs are reduced to a minimum before the shuffle, and no
join sends a table through the driver. The work ends when every vertex points straight at the smallest of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tackline.llm.durable import checkpointed


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each child has one parent and no parent is a child."""
    if not edges.groupBy("child").count().where("count > 1").isEmpty():
        return False
    parents = edges.select(F.col("parent").alias("child")).distinct()
    return edges.join(parents.hint("merge"), "child", "left_semi").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, root) of every vertex that is not the smallest of its component.

    ``edges`` has two columns of long ids; loops and repeated edges do no harm.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).where("child > parent").distinct()
    edges = checkpointed(edges)
    for _ in range(most_rounds):
        if _is_star_forest(edges):
            return edges.select(F.col("child").alias("vertex"), F.col("parent").alias("root"))
        both = edges.union(edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))).toDF("at", "other")
        least = both.groupBy("at").agg(F.min("other").alias("m")).select("at", F.least("at", "m").alias("m"))
        large = both.where("other > at").join(least.hint("merge"), "at").select(F.col("other").alias("child"), F.col("m").alias("parent")).where("child > parent").distinct()
        least = large.groupBy("child").agg(F.min("parent").alias("m"))
        small = large.join(least.hint("merge"), "child").select(F.col("parent").alias("child"), F.col("m").alias("parent")).where("child > parent").union(least.select("child", "m")).distinct()
        edges = checkpointed(small)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
