"""Answers over hits: what models are asked and say, with hooks in their place, and the payload that is returned.

A hook is a Column function of Columns (a pandas UDF, say); nothing here calls a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import text as T
from quillspark.operators import evidence
from quillspark.session import discard, materialize

# What is returned where nothing is known, and how much of a hit a summary shows.
ROUTER_DEFAULT, TYPE_DEFAULT = "RETRIEVE", "fact"
REFUSAL = "根据现有资料无法回答该问题。"
SUMMARY_HITS, SUMMARY_CHARS = 3, 160


def routed(queries: DataFrame, chat: tuple[str, ...], domain: tuple[str, ...], general: tuple[str, ...], ask: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds decision and decided_by: by the words where they tell, else by ``ask`` (RETRIEVE or DIRECT of a query), else to retrieve."""
    words = evidence.route(F.col("query"), chat, domain, general)
    said = ask(F.col("query")) if ask is not None else F.lit(None).cast("string")
    said = F.when(said.isin("RETRIEVE", "DIRECT"), said)
    by = F.when(words.isNotNull(), "words").when(said.isNotNull(), "model").otherwise("default")
    return queries.withColumn("decision", F.coalesce(words, said, F.lit(ROUTER_DEFAULT))).withColumn("decided_by", by)


def rewritten(queries: DataFrame, rewrite: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds search_query and query_type from a model's JSON {"query", "query_type"}; the query itself and "fact" where that can't be read."""
    if rewrite is None:
        return queries.withColumn("search_query", F.col("query")).withColumn("query_type", F.lit(TYPE_DEFAULT))
    said = evidence.from_json_text(rewrite(F.col("query")), "query string, query_type string")
    rows = queries.withColumn("said__", said)
    text = F.nullif(T.strip("said__.query"), F.lit(""))
    kind = F.when(F.col("said__.query_type").isin("fact", "compare", "summary"), F.col("said__.query_type"))
    return rows.withColumn("search_query", F.coalesce(text, "query")).withColumn("query_type", F.coalesce(kind, F.lit(TYPE_DEFAULT))).drop("said__")


CLAIMS = "answer string, confidence string, claims array<struct<claim:string,citations:array<string>>>"


def answered(queries: DataFrame, items: DataFrame, refusals: DataFrame, generate: Callable[[Column, Column], Column] | None = None, prefix: str = "") -> DataFrame:
    """query_id, answer, confidence, claims, used_evidence, should_refuse, source (refused, model or extract) of every query.

    items: evidence of each query (query_id, rank, evidence_id, text); refusals:
    query_id, should_refuse. ``generate`` gives a model's JSON (CLAIMS) for a query and
    its prompt; claims keep citations of their query's evidence only. Without a model,
    or where its output can't be read, the first sentences of the best evidence answer.
    """
    known = items.groupBy("query_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("known__"))
    rows = queries.join(refusals, "query_id", "left").join(known, "query_id", "left").join(evidence.evidence_prompt(items), "query_id", "left")
    rows = rows.join(evidence.summary_answer(items, prefix).withColumnRenamed("answer", "extract__"), "query_id", "left")
    refuse = F.coalesce("should_refuse", F.lit(True)) | F.col("known__").isNull()
    said = evidence.from_json_text(generate(F.col("query"), F.coalesce("prompt", F.lit(""))), CLAIMS) if generate is not None else F.lit(None).cast("struct<" + ",".join(x.replace(" ", ":", 1) for x in CLAIMS.split(", ")) + ">")
    rows = rows.withColumn("refuse__", refuse).withColumn("said__", F.when(~refuse, said))
    usable = F.coalesce(T.strip("said__.answer") != "", F.lit(False))
    none = F.array().cast("array<struct<claim:string,citations:array<string>>>")
    claims = F.when(usable, evidence.valid_claims(F.coalesce("said__.claims", none), F.coalesce("known__", F.array().cast("array<string>")))).otherwise(none)
    rows = rows.withColumn("claims", claims)
    return rows.select(
        "query_id",
        F.when(F.col("refuse__"), REFUSAL).when(usable, T.strip("said__.answer")).otherwise(F.coalesce("extract__", F.lit(REFUSAL))).alias("answer"),
        F.when(F.col("refuse__"), "low").when(usable, F.coalesce("said__.confidence", F.lit("medium"))).otherwise("medium").alias("confidence"),
        "claims", evidence.used_evidence(F.col("claims")).alias("used_evidence"), F.col("refuse__").alias("should_refuse"),
        F.when(F.col("refuse__"), "refused").when(usable, "model").otherwise("extract").alias("source"),
    )


def retrieval_summary(hits: DataFrame, top: int = SUMMARY_HITS, chars: int = SUMMARY_CHARS) -> DataFrame:
    """query_id, n_hits, preview: how many hits a query has, and rank, id and the beginning of the first ``top`` of them."""
    item = F.struct("rank", F.col("id"), F.substring(T.compact(F.coalesce("text", F.lit(""))), 1, chars).alias("text"))
    rows = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.array_sort(F.collect_list(F.when(F.col("rank") <= top, item))).alias("preview"))
    return rows.select("query_id", "n_hits", "preview")


def payloads(queries: DataFrame, answers: DataFrame, summary: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """query_id, payload: everything on a query as one JSON object; timings (query_id, stage, seconds) in order of their stages."""
    rows = queries.join(answers, "query_id", "left").join(summary, "query_id", "left")
    if timings is not None:
        stages = timings.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("stage", "seconds"))).alias("timings"))
        rows = rows.join(stages, "query_id", "left")
    keep = [c for c in rows.columns if c != "query_id"]
    return rows.select("query_id", F.to_json(F.struct("query_id", *keep)).alias("payload"))


class Session:
    """Rounds of questions with the last turns as history: each ``ask`` is a batch of one round of many conversations.

    search: DataFrame (query_id, query, history) to hits (query_id, rank, id, score,
    text). State is the turns' table, which each round writes.
    """

    def __init__(self, turns: DataFrame, search: Callable[[DataFrame], DataFrame], rounds: int = 6, score: str = "score", below: float = evidence.REFUSE_BELOW, generate: Callable[[Column, Column], Column] | None = None):
        self.turns, self.search, self.rounds, self.score, self.below, self.generate = turns, search, rounds, score, below, generate

    def ask(self, queries: DataFrame) -> DataFrame:
        """query_id, payload of queries (query_id, query), a row per conversation; its question and answer become turns of the next round."""
        last = self.turns.groupBy(F.col("conv_id").alias("query_id")).agg(F.slice(F.sort_array(F.collect_list(F.struct("turn", "role", "text")), False), 1, self.rounds).alias("t"), F.max("turn").alias("last__"))
        said = F.array_join(F.transform(F.reverse("t"), lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n")
        asked = queries.join(last, "query_id", "left").withColumn("history", F.coalesce(said, F.lit(""))).drop("t")
        asked = materialize(asked, "asked")  # it reads the turns that this round replaces
        hits = materialize(self.search(asked.drop("last__")), "hits")
        items = evidence.evidence_items(hits)
        found = materialize(answered(queries, items, evidence.refusals(queries, hits, self.score, self.below), self.generate), "answers")
        number = F.coalesce("last__", F.lit(0))
        new = asked.join(found.select("query_id", "answer"), "query_id").select(
            F.col("query_id").alias("conv_id"), F.inline(F.array(F.struct((number + 1).alias("turn"), F.lit("user").alias("role"), F.col("query").alias("text")), F.struct((number + 2).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))))
        )
        # written: what a model said is not asked again, and a round's plan doesn't hold those before it
        before, self.turns = self.turns, materialize(self.turns.select("conv_id", "turn", "role", "text").unionByName(new), "turns")
        discard(before)
        return payloads(asked.drop("last__"), found, retrieval_summary(hits))
