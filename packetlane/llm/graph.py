"""Connected components of large graphs, by DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlane.llm.store import dropped, written


def roots(step: DataFrame) -> DataFrame:
    """step: id, to, with to < id or to = id. Follows each `to` to its end; jumps double their reach every time."""
    while True:
        on = step.select(F.col("id").alias("to"), F.col("to").alias("far"))
        jumped = step.select("id", "to").join(on, "to", "left").select("id", F.coalesce("far", "to").alias("to"), F.coalesce(F.col("far") < F.col("to"), F.lit(False)).alias("moved"))
        jumped = written(jumped)
        dropped(step)
        if jumped.where("moved").isEmpty():
            return jumped
        step = jumped


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for each id that an edge (a, b) touches; component_id is the smallest id reachable.

    Each round sends every node to the least of its neighbours and itself, follows these choices to their ends by
    doubling jumps, replaces edges by those between the ends, and drops loops and repeats. A path in order takes
    one round and as many jumps as the logarithm of its length, a star at most two rounds; in general the nodes left
    are those below all of their neighbours. Sums of rounds are composed afterwards. Grouping is pre-aggregated,
    and joins are plain equi-joins on a unique side, which adaptive execution may split where a node has very many edges.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = roots(written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("to"))))
        steps.append(step)
        left = edges.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
        moved = left.join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        fewer = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct())
        dropped(edges)
        edges = fewer
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    out = steps[-1].select("id", F.col("to").alias("component_id"))
    for step in reversed(steps[:-1]):
        out = written(step.select("id", "to").join(out.withColumnRenamed("id", "to"), "to", "left").select("id", F.coalesce("component_id", "to").alias("component_id")))
    return out
