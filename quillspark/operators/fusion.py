"""Fusion of two ranked lists per query: weighted sum of normalised scores, or reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

# Fixed value: the usual constant of reciprocal rank fusion.
RRF_K = 60


def _cut(hits: DataFrame, k: int) -> DataFrame:
    return hits.where(F.col("rank") <= k)


def normalized(hits: DataFrame) -> DataFrame:
    """Adds ``norm``: scores of each query's list from 0 (its worst) to 1; a flat list is 1, or 0 if not positive."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    flat = F.when(hi <= 0, 0.0).otherwise(1.0)
    return hits.withColumn("norm", F.when(hi - lo < 1e-12, flat).otherwise((F.col("score") - lo) / F.nullif(hi - lo, F.lit(0.0))))


def merged(first: DataFrame, second: DataFrame, candidates: int) -> DataFrame:
    """query_id, id, a_rank, a_norm, b_rank, b_norm: both candidate lists, a row per item of either."""
    a = normalized(_cut(first, candidates)).select("query_id", "id", F.col("rank").alias("a_rank"), F.col("norm").alias("a_norm"))
    b = normalized(_cut(second, candidates)).select("query_id", "id", F.col("rank").alias("b_rank"), F.col("norm").alias("b_norm"))
    return a.join(b, ["query_id", "id"], "full")


def _ranked(rows: DataFrame, k: int, *by: str) -> DataFrame:
    # ties keep the order of the first list, then of the second
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("a_rank"), F.asc_nulls_last("b_rank"), "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select(*by, "rank", "id", "score")


def weighted_sum(both: DataFrame, a_weight: float, b_weight: float, k: int) -> DataFrame:
    zero = F.lit(0.0)
    score = F.round(a_weight * F.coalesce("a_norm", zero) + b_weight * F.coalesce("b_norm", zero), 6)
    return _ranked(both.withColumn("score", score), k, "query_id")


def reciprocal_rank(both: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    return _ranked(both.withColumn("score", F.round(part("a_rank") + part("b_rank"), 6)), k, "query_id")


def sweep(both: DataFrame, weights: list[tuple[float, float]], constants: list[int], k: int) -> DataFrame:
    """All settings over the same candidates in one plan: setting, query_id, rank, id, score."""
    zero = F.lit(0.0)
    settings = [
        F.struct(F.lit(f"weighted({a}/{b})").alias("setting"), F.round(a * F.coalesce("a_norm", zero) + b * F.coalesce("b_norm", zero), 6).alias("score")) for a, b in weights
    ] + [
        F.struct(F.lit(f"rrf({c})").alias("setting"), F.round(F.coalesce(1.0 / (c + F.col("a_rank")), zero) + F.coalesce(1.0 / (c + F.col("b_rank")), zero), 6).alias("score"))
        for c in constants
    ]
    rows = both.select("*", F.inline(F.array(*settings)))
    return _ranked(rows, k, "setting", "query_id")
