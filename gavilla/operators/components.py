"""Connected components and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gavilla.operators.keys import attach, number_rows
from gavilla.session import materialise, release


def _large_star(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The moved edges, and a table to release once they are written."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("n"))
    low = materialise(low, "low")
    near = attach(both, low, ["u"], 2 * total)
    return near.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), low


def _small_star(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    low = edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    low = materialise(low, "low")
    near = attach(edges, low, ["u"], total)
    moved = near.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), low


def _is_star(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    ends = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for every id in the edges (a, b); root is the smallest id of the component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Every round is a grouped
    minimum, which is combined before the shuffle, and a join back that broadcasts hot nodes.
    """
    a, b = edges.columns[:2]
    start = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = materialise(start.distinct(), "edges")
    for _ in range(max_rounds):
        total = current.count()
        moved, low = _large_star(current, total)
        wide = materialise(moved, "large")
        moved, lower = _small_star(wide, wide.count())
        narrow = materialise(moved, "small")
        release(current, wide, low, lower)
        current = narrow
        if _is_star(current):
            roots = current.select(F.col("v").alias("id")).distinct()
            return current.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
                roots.select("id", F.col("id").alias("root"))
            )
    raise RuntimeError("components did not settle")


def label_components(ids: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, cluster): components of two or more ids numbered by their smallest id, the others -1."""
    roots = materialise(roots, "roots")
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    groups = materialise(number_rows(sizes, ["root"], "cluster"), "groups")
    total = roots.count()
    known = attach(roots, groups, ["root"], total).select("id", "cluster")
    return ids.select("id").join(known, "id", "left").select(
        "id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster")
    )
