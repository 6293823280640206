"""Evaluation over settings: chunk configurations, indexes and routes, and judging that resumes."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.operators import dense, evaluation
from quillspark.retriever import Retriever, Settings
from quillspark.sources import readers, writers


def chunk_grid(configurations: dict[tuple[int, int], DataFrame], queries: DataFrame, gold: DataFrame, route: str = "bm25", settings: Settings | None = None) -> DataFrame:
    """chunk_size, overlap, chunks and mean hit_at_k of every configuration's chunks (chunk_id, doc_id, text, block_ids).

    gold: query_id, doc_id, block_id; a query is hit if all its pairs are in the first k.
    """
    out = None
    for (size, overlap), chunks in configurations.items():
        hits = Retriever(chunks, settings).search(queries, route)
        pairs = hits.join(chunks.select(F.col("chunk_id").alias("id"), "block_ids"), "id")
        pairs = pairs.select("query_id", "rank", F.explode(F.transform("block_ids", lambda b: F.concat_ws("#", F.col("doc_id").cast("string"), b))).alias("id"))
        wanted = gold.select("query_id", F.concat_ws("#", F.col("doc_id").cast("string"), "block_id").alias("id"))
        strict = evaluation.strict_hits(pairs, wanted)
        row = strict.agg(*(F.round(F.avg(f"hit_at_{c}"), 6).alias(f"hit_at_{c}") for c in evaluation.CUTS))
        row = row.select(F.lit(size).alias("chunk_size"), F.lit(overlap).alias("overlap"), F.lit(chunks.count()).cast("long").alias("chunks"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def timed_build(build: Callable[[], object]) -> tuple[object, float]:
    """What a build gives, and the seconds it took."""
    began = time.time()
    made = build()
    return made, round(time.time() - began, 3)


def folder_mb(spark: SparkSession, path: str) -> float:
    """The size of all files below a path, as its file system tells it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return round(at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() / (1 << 20), 3)


def index_comparison(indexes: dict[str, Callable[[DataFrame, int], DataFrame]], queries: DataFrame, exact: DataFrame, k: int = 10, runs: int = 3, built: dict[str, tuple[float, str]] | None = None) -> list[dict]:
    """For each index (a search of queries and k): its mean overlap with the exact hits, the mean milliseconds a query of warmed runs, and its build and size.

    built: seconds and folder of the indexes that lie on disk; build_s and mb are None for others.
    """
    n, out = max(1, queries.count()), []
    for name, search in indexes.items():
        shared = dense.overlap(search(queries, k), exact, k).agg(F.avg("overlap")).first()[0]
        began = time.time()
        for _ in range(runs):
            search(queries, k).write.format("noop").mode("overwrite").save()
        ms = round(1000 * (time.time() - began) / runs / n, 3)
        seconds, path = (built or {}).get(name, (None, None))
        out.append({"index": name, "overlap": round(float(shared or 0.0), 6), "ms": ms, "build_s": seconds, "mb": folder_mb(queries.sparkSession, path) if path else None})
    return out


def generated(records: DataFrame, load: Callable[[], Callable[[str], str]], prompt: str = "prompt") -> DataFrame:
    """Adds ``answer`` and ``error`` to records: what a model says to each prompt; one that fails has its error and no answer, and stops nothing.

    load: gives the model's function of a prompt, once in each worker. If it can't be
    loaded, that is every record's error.
    """
    names = records.columns

    def run(batches):
        model, failed = None, None
        for held in batches:
            answers, errors = [], []
            for text in held[prompt]:
                if model is None and failed is None:
                    try:
                        model = load()
                    except Exception as e:
                        failed = f"{type(e).__name__}: {e}"
                said, error = None, failed
                if failed is None:
                    try:
                        said = model(text)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                answers.append(said)
                errors.append(error)
            yield held.assign(answer=pd.array(answers, "object"), error=pd.array(errors, "object"))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name not in ("answer", "error"))
    return records.select(*(n for n in names if n not in ("answer", "error"))).mapInPandas(run, f"{kinds}, answer string, error string")


def judged(records: DataFrame, scores: Callable[[DataFrame], DataFrame], checkpoint: str, query_type: str | None = None, limit: int | None = None) -> DataFrame:
    """query_type, n and means of each metric over all records that have been judged, those of earlier runs too.

    scores: records to (qid, query_type, metrics map<string,double>). What the
    checkpoint holds is not judged again. limit: a smoke test's first records by qid.
    """
    spark = records.sparkSession
    todo = records if query_type is None else records.where(F.col("query_type") == query_type)
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        todo = readers.remaining(todo, readers.checkpoint_rows(spark, checkpoint))
    todo = todo if limit is None else todo.orderBy("qid").limit(limit)
    writers.append_checkpoint(scores(todo).select("qid", "query_type", "metrics", F.current_timestamp().cast("string").alias("timestamp")), checkpoint)
    done = readers.checkpoint_rows(spark, checkpoint)
    names = sorted(r[0] for r in done.select(F.explode(F.map_keys("metrics"))).distinct().collect())  # a handful of metrics
    rows = done.select("query_type", *(F.col("metrics")[m].alias(m) for m in names))
    return evaluation.rollup_means(rows, "query_type", names)


def answer_records(queries: DataFrame, answers: DataFrame, items: DataFrame, reference: str | Column) -> DataFrame:
    """What judges read: query_id, question, reference, answer, contexts in rank order."""
    contexts = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))
    rows = queries.select("query_id", F.col("query").alias("question"), (F.col(reference) if isinstance(reference, str) else reference).alias("reference"))
    rows = rows.join(answers.select("query_id", "answer"), "query_id", "left").join(contexts, "query_id", "left")
    empty = F.array().cast("array<string>")
    return rows.select("query_id", "question", "reference", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce(F.transform("c", lambda x: x["text"]), empty).alias("contexts"))
