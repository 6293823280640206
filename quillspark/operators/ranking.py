"""Order-sensitive selection on ranked hits (query_id, branch, rank, ...), always by window, never by loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def per_group_cap(hits: DataFrame, by: list[str], group: str, most: int = 2) -> DataFrame:
    """Keeps the first ``most`` hits of each ``group`` value in every list, in rank order."""
    w = Window.partitionBy(*by, group).orderBy("rank")
    return hits.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= most).drop("n__")


def rerank_positions(hits: DataFrame, by: list[str]) -> DataFrame:
    """Ranks from 1 again after rows have gone."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("rank")).cast("long"))


def keep_first(hits: DataFrame, by: list[str], key: str, order: list[str]) -> DataFrame:
    """One row per ``key``: the first in ``order``."""
    w = Window.partitionBy(*by, key).orderBy(*order)
    return hits.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def branch_union(hits: DataFrame, per_branch: int, k: int, order: tuple[str, ...] = ("score",)) -> DataFrame:
    """Compare plans: each branch's first hits, each item once (by branch, then rank), best scores first."""
    rows = keep_first(hits.where(F.col("rank") <= per_branch), ["query_id"], "id", ["branch", "rank"])
    w = Window.partitionBy("query_id").orderBy(*map(F.desc, order), "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def quota_merge(hits: DataFrame, quota: int, extra: int, k: int, order: tuple[str, ...] = ("score",)) -> DataFrame:
    """Summary plans: ``quota`` hits of each branch, then the ``extra`` best left over that are not there yet, best scores first."""
    first = keep_first(hits.where(F.col("rank") <= quota), ["query_id"], "id", ["branch", "rank"])
    rest = hits.where(F.col("rank") > quota).join(first.select("query_id", "id"), ["query_id", "id"], "left_anti")
    w = Window.partitionBy("query_id", "id").orderBy(*map(F.desc, order), "branch", "rank")
    rest = rest.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")
    w = Window.partitionBy("query_id").orderBy(*map(F.desc, order), "branch", "id")
    rest = rest.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= extra).drop("n__")
    w = Window.partitionBy("query_id").orderBy(*map(F.desc, order), "id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def rerank(hits: DataFrame, score, k: int) -> DataFrame:
    """Second stage: ``score`` is a Column (or a pandas UDF's) over a hit; best first, then the first stage's score."""
    rows = hits.withColumn("rerank_score", score)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
