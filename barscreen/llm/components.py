"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round groups and joins edges on a vertex; every edge keeps at least one way to its component's smallest
vertex. Rounds are cut off by a table written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) for every vertex of edges (u, v) that is not its component's smallest vertex.

    Loops and edges with a null end are ignored. Raises if it has not settled after `rounds` rounds
    (the number of rounds grows with the logarithm of a component's size squared at most).
    """
    edges = edges.select("u", "v").filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, before = written(edges.distinct(), "edges"), None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        before = now
        edges = written(_small_star(_large_star(edges)), "edges")
    raise RuntimeError(f"components have not settled after {rounds} rounds")
