"""From hits to answers: evidence items, the refusal gate, support of claims, routing and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T

# Lengths, thresholds and words that results depend on.
EVIDENCE_CHARS, REFUSE_BELOW = 900, 0.5
SUPPORT_SHARE, SUPPORT_TOKENS, PHRASE_CHARS = 0.4, 3, 4
STOPWORDS = ("the", "and", "of", "to", "in", "is", "for", "on", "with", "that")
ENTITY = r"\d{6}\.(?:SH|SZ)|\d{6}|[A-Za-z]{1,5}\.[A-Z]+"


def evidence_items(hits: DataFrame, text: str = "text", chars: int = EVIDENCE_CHARS) -> DataFrame:
    """Adds evidence_id (E1, E2, ... in rank order) and the text cut to ``chars``."""
    return hits.withColumn("evidence_id", F.concat(F.lit("E"), F.col("rank").cast("string"))).withColumn(text, T.strip(F.substring(F.coalesce(text, F.lit("")), 1, chars)))


def evidence_prompt(items: DataFrame) -> DataFrame:
    """query_id, prompt: a query's evidence as numbered paragraphs."""
    part = F.concat(F.lit("["), F.col("evidence_id"), F.lit("] "), F.col("text"))
    rows = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("parts"))
    return rows.select("query_id", F.array_join(F.transform("parts", lambda p: p["p"]), "\n\n").alias("prompt"))


def refusals(queries: DataFrame, hits: DataFrame, score: str, below: float = REFUSE_BELOW) -> DataFrame:
    """query_id, should_refuse: whether a query has no hit, or none that scores ``below`` or more."""
    gate = hits.groupBy("query_id").agg(F.bool_and(F.col(score) < below).alias("weak"))
    return queries.select("query_id").distinct().join(gate, "query_id", "left").select("query_id", F.coalesce("weak", F.lit(True)).alias("should_refuse"))


def _words(text: Column) -> Column:
    found = F.array_distinct(T.tokens(text))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def claim_supported(claim: Column, cited: Column) -> Column:
    """Whether a claim's numbers all stand in the cited text, and enough of its words or phrases do."""
    norm = lambda x: F.lower(T.compact(F.coalesce(x, F.lit(""))))
    numbers = F.regexp_extract_all(F.coalesce(claim, F.lit("")), F.lit(r"(\d+(?:\.\d+)?%?)"), F.lit(1))
    asked, there = _words(claim), _words(cited)
    shared = F.size(F.array_intersect(asked, there))
    phrases = F.filter(F.split(F.coalesce(claim, F.lit("")), r"[，。；、,:：\s]+"), lambda p: F.length(p) >= PHRASE_CHARS)
    said = F.exists(phrases, lambda p: F.contains(norm(cited), norm(p)))
    enough = (shared >= SUPPORT_SHARE * F.size(asked)) | (shared >= SUPPORT_TOKENS) | ((shared >= 2) & said)
    ok = F.when(F.size(asked) == 0, F.contains(norm(cited), norm(claim))).otherwise(enough)
    stated = F.forall(numbers, lambda n: F.contains(F.coalesce(cited, F.lit("")), n))
    return (norm(claim) != "") & (norm(cited) != "") & stated & ok


def valid_claims(claims: Column, known: Column) -> Column:
    """Claims array<struct<claim, citations>> without blank ones, citations only of known evidence."""
    kept = F.filter(claims, lambda c: T.strip(F.coalesce(c["claim"], F.lit(""))) != "")
    return F.transform(kept, lambda c: F.struct(T.strip(c["claim"]).alias("claim"), F.filter(c["citations"], lambda e: F.array_contains(known, e)).alias("citations")))


def used_evidence(claims: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(claims, lambda c: c["citations"]))))


def summary_answer(items: DataFrame, prefix: str, top: int = 3) -> DataFrame:
    """query_id, answer: the first sentences of the best evidence, as the fallback answer."""
    rows = items.where(F.col("rank") <= top).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", T.first_sentence("text").alias("s")))).alias("parts"))
    return rows.select("query_id", F.concat(F.lit(prefix), F.array_join(F.transform("parts", lambda p: p["s"]), "；")).alias("answer"))


def route(query: Column, chat: tuple[str, ...], domain: tuple[str, ...], general: tuple[str, ...]) -> Column:
    """DIRECT for chat, RETRIEVE for domain terms only, DIRECT for general terms only, else null (ask a model)."""
    low = F.lower(T.strip(query))
    holds = lambda words, text: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    in_domain, is_general = holds(domain, low) | query.rlike(ENTITY), holds(general, low)
    return F.when(holds(chat, query), "DIRECT").when(in_domain & ~is_general, "RETRIEVE").when(is_general & ~in_domain, "DIRECT")


def history(turns: DataFrame, rounds: int = 6) -> DataFrame:
    """conv_id, turn and the texts of up to ``rounds`` turns before it, as one text; turns (conv_id, turn, role, text)."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-rounds, -1)
    said = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", F.array_join(F.collect_list(said).over(w), "\n").alias("history"))


def from_json_text(text: Column, schema: str) -> Column:
    """A JSON object in a model's output: the whole text, else from the first brace to the last."""
    read = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))
    return F.coalesce(read(text), read(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))))
