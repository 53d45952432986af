"""Connected components of a links table by contraction, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.tables import Scratch, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id that has a link to another; root is the smallest id reachable, itself included.

    Links may be repeated, in either direction, or lead to themselves; those with a null end are ignored. An empty table
    gives no rows. Each round points every id at its smallest neighbour if that is smaller, follows the pointers to
    their ends and keeps the links between different ends. At least half of the linked ids go per round, so rounds are
    logarithmic in the size of a component. Nothing is gathered: hubs are met by grouped minima and by joins that
    adaptive execution may split."""
    with Scratch(links.sparkSession) as scratch:
        return stored(_components(links, a, b, scratch.stored), "roots")


def _components(links: DataFrame, a: str, b: str, stored) -> DataFrame:
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges = stored(edges, "edges")
    known = None
    while not edges.isEmpty():
        step = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
        step = stored(step, "step")
        while True:
            up = step.select(F.col("id").alias("root"), F.col("root").alias("higher"))
            jumped = step.join(up, "root", "left").select(
                "id", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved"))
            jumped = stored(jumped, "jump")
            moved = not jumped.where("moved").isEmpty()
            step = jumped.drop("moved")
            if not moved:
                break
        known = step if known is None else known.unionByName(step)
        left = step.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        moved_edges = edges.join(left, "a", "left").join(right, "b", "left").select(
            F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        edges = stored(moved_edges.where("x <> y").select(
            F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    if known is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    # an end of one round may have moved in a later one
    while True:
        up = known.select(F.col("id").alias("root"), F.col("root").alias("higher"))
        jumped = stored(known.join(up, "root", "left").select(
            "id", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "jump")
        again = not jumped.where("moved").isEmpty()
        known = jumped.drop("moved")
        if not again:
            break
    ends = known.select(F.col("root").alias("id"), F.col("root")).distinct()
    return known.unionByName(ends)
