"""Connected components of a distributed edge table, without collecting any of it.

Alternating large-star and small-star rounds: each round joins every node with the
smallest neighbour it knows, and writes the edges that result, until they are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.session import discard, materialize

MAX_ROUNDS = 60


def _stars(edges: DataFrame, n: int) -> bool:
    """Whether each node u has one edge, to a v that has none of its own."""
    return n == edges.agg(F.count_distinct("u")).first()[0] and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes that are not the smallest of theirs.

    Edges with a null end or both ends equal are no edges; repeated edges count once;
    an empty table gives an empty one. A node that does not appear is its own component.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    e = materialize(e.distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        n = e.count()
        if _stars(e, n):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large", n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", 2 * n)
        discard(e, large)
        e = new
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
