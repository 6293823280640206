"""Search of an index from the command line: python -m quillspark.search INDEX QUERY [--route all] [--top-k 10] [--rerank] [--encoder MODULE:NAME] [--output DIR]."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import functions as F

from quillspark.retriever import ROUTES, Retriever, Settings
from quillspark.session import get_spark
from quillspark.sources import writers


def run(arguments: list[str] | None = None, spark=None):
    """The hits, shown; written too where an output folder is given."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("index")
    parser.add_argument("query")
    parser.add_argument("--route", default="all", choices=("all", *ROUTES))
    parser.add_argument("--top-k", type=int, default=10)
    parser.add_argument("--first-stage", type=int, default=50)
    parser.add_argument("--title-weight", type=float, default=0.0)
    parser.add_argument("--rerank", action="store_true")
    parser.add_argument("--encoder", help="a Column function of the query's text to a vector, for routes with vectors")
    parser.add_argument("--output")
    a = parser.parse_args(arguments)
    spark = spark or get_spark()
    module, _, name = (a.encoder or "").partition(":")
    encode = getattr(importlib.import_module(module), name) if name else None
    found = Retriever.load(spark, a.index, encode=encode, settings=Settings(top_k=a.top_k, first_stage=a.first_stage, title_weight=a.title_weight))
    asked = spark.createDataFrame([(0, a.query)], "query_id int, query string")
    if a.route == "all" and (encode is not None or not found.has_vectors):
        hits = found.search_all(asked, a.top_k, a.rerank)
    elif a.route == "all":
        raise SystemExit("routes with vectors need an encoder: give --encoder, or --route bm25")
    else:
        hits = (found.two_stage(asked, route=a.route, k=a.top_k) if a.rerank else found.search(asked, a.route, a.top_k)).withColumn("route", F.lit(a.route))
    hits = hits.join(asked, "query_id")
    hits.orderBy("route", "rank").show(a.top_k, truncate=80)
    if a.output:
        writers.write_per_query(hits, a.output)
    return hits


if __name__ == "__main__":
    run()
