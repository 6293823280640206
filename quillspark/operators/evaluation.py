"""Retrieval metrics over hits (query_id, rank, id) and grouped gold (query_id, component, id).

Any gold id of a component matches it; a query needs all its components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

CUTS = (3, 5, 10)


def component_ranks(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, component, first: the best rank that matches, null if none does."""
    pairs = gold.select("query_id", "component", "id").distinct()
    return pairs.join(hits.select("query_id", "id", "rank"), ["query_id", "id"], "left").groupBy("query_id", "component").agg(F.min("rank").alias("first"))


def grouped_metrics(hits: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = CUTS, k: int = 10) -> DataFrame:
    """A row per query with gold: recall_at_k (all components found), mrr and ndcg_local of the first ``k``, partial and any hits."""
    ranks = component_ranks(hits, gold)
    whole = F.when(F.count("first") == F.count("*"), F.max("first"))
    found = F.count_if(F.col("first") <= k)
    per_query = ranks.groupBy("query_id").agg(
        *(F.coalesce((whole <= c).cast("double"), F.lit(0.0)).alias(f"recall_at_{c}") for c in cuts),
        F.round(F.coalesce(F.when(whole <= k, 1.0 / whole), F.lit(0.0)), 6).alias("mrr"),
        F.round(found / F.count("*"), 6).alias("partial_hit"),
        (found > 0).cast("double").alias("any_hit"),
    )
    return per_query.join(ndcg_local(hits, gold, k), "query_id", "left").withColumn("ndcg_local", F.coalesce("ndcg_local", F.lit(0.0)))


def ndcg_local(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg_local: a hit gains the number of components it matches; the ideal is the same gains in the best order."""
    gains = hits.where(F.col("rank") <= k).join(gold.select("query_id", "component", "id").distinct(), ["query_id", "id"])
    gains = gains.groupBy("query_id", "id").agg(F.min("rank").alias("rank"), F.count_distinct("component").alias("gain"))
    best = Window.partitionBy("query_id").orderBy(F.desc("gain"), "rank")
    part = lambda at: F.sum(F.col("gain") / F.log2(at + 1))
    return (
        gains.withColumn("ideal", F.row_number().over(best)).groupBy("query_id").agg(F.round(part(F.col("rank")) / part(F.col("ideal")), 6).alias("ndcg_local"))
    )


def strict_hits(hits: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """query_id, hit_at_k: 1 if every gold id is among the first k (ungrouped gold)."""
    return component_ranks(hits, gold.withColumn("component", F.col("id"))).groupBy("query_id").agg(
        *(F.when(F.count("first") == F.count("*"), (F.max("first") <= c).cast("long")).otherwise(0).cast("long").alias(f"hit_at_{c}") for c in cuts)
    )


def first_match(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rr: one over the rank of the first hit that matches anything."""
    rank = component_ranks(hits, gold).groupBy("query_id").agg(F.min("first").alias("r"))
    return rank.select("query_id", F.round(F.coalesce(F.when(F.col("r") <= k, 1.0 / F.col("r")), F.lit(0.0)), 6).alias("rr"))


def rollup_means(per_query: DataFrame, by: str, metrics: list[str], total: str = "average", digits: int = 6) -> DataFrame:
    """``by``, n and the mean of each metric, for each value and over all (``total``); missing and NaN values don't count, and n_<metric> says how many do."""
    clean = lambda m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
    rows = per_query.rollup(by).agg(
        F.grouping(by).alias("all__"), F.count("*").alias("n"), *(F.round(F.avg(clean(m)), digits).alias(m) for m in metrics), *(F.count(clean(m)).alias(f"n_{m}") for m in metrics)
    )
    return rows.withColumn(by, F.when(F.col("all__") == 1, F.lit(total)).otherwise(F.col(by))).drop("all__")


def winners(means: DataFrame, routes: tuple[str, str], metric: str) -> DataFrame:
    """Compares a metric of two routes in rows (group, route, metric): which is higher, or tie."""
    wide = means.groupBy("group").pivot("route", list(routes)).agg(F.first(metric))
    a, b = (F.col(r) for r in routes)
    return wide.withColumn("winner", F.when(F.abs(a - b) <= 1e-12, "tie").when(a > b, routes[0]).otherwise(routes[1]))


def matched_components(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, rank, id, matched: for each hit the components, and groups of equivalent evidence in them, that it holds a pair of.

    hits: query_id, rank, id, doc_id, block_ids; gold: query_id, component, group_id,
    doc_id, block_id. matched: array<struct<component, group_id, block_ids>> in order,
    empty for a hit that matches nothing.
    """
    pairs = hits.select("query_id", "rank", "id", "doc_id", F.explode("block_ids").alias("block_id"))
    found = pairs.join(gold.select("query_id", "component", "group_id", "doc_id", "block_id").distinct(), ["query_id", "doc_id", "block_id"])
    groups = found.groupBy("query_id", "id", "component", "group_id").agg(F.array_sort(F.collect_set("block_id")).alias("block_ids"))
    report = groups.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("component", "group_id", "block_ids"))).alias("matched"))
    rows = hits.select("query_id", "rank", "id").join(report, ["query_id", "id"], "left")
    empty = F.array().cast(report.schema["matched"].dataType)
    return rows.select("query_id", "rank", "id", F.coalesce("matched", empty).alias("matched"))


def comparison(means: DataFrame, routes: list[str], metrics: list[str], group: str = "query_type") -> DataFrame:
    """group, metric, a column per route, best: the route of the highest mean, the first of those within 1e-12 of it."""
    long = means.select(group, "route", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))))
    wide = long.groupBy(group, "metric").pivot("route", routes).agg(F.first("value"))
    top = F.greatest(*(F.col(r) for r in routes)) if len(routes) > 1 else F.col(routes[0])
    best = F.coalesce(*(F.when(top - F.col(r) <= 1e-12, F.lit(r)) for r in routes))
    return wide.withColumn("best", best)
