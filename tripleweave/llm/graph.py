"""Connected components by alternating large-star and small-star, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.plans.rounds import cut


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of ``u`` goes to the least of ``u`` and its neighbours."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``u`` and its smaller neighbours go to the least of them; edges point from large to small."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges (u, v)``; the root is the least node of the component.

    Loops and edges with a null end say nothing and are dropped; repeated edges count once. The
    minimum of a node is combined before the shuffle and joined back, so a hub's edges are never in
    one row; rounds grow with the logarithm of the longest path.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state = cut(ordered.distinct(), "edges")
    seen = _print(state)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        state = cut(_small_star(_large_star(state).distinct()).distinct(), "edges")
        now = _print(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components: edges still moving after max_rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
