"""One entry point for search: routes, fusion, decomposition and two stages, for whole batches of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators import decompose, dense, fusion, lexical, ranking
from quillspark.session import discard, materialize

ROUTES = ("vector", "bm25", "hybrid_weightsum", "hybrid_rrf")
HYBRID = ("hybrid", "hybrid_weightsum", "hybrid_rrf")


@dataclass
class Settings:
    """Sizes and weights of a search; the weights are the vector's and BM25's."""

    top_k: int = 10
    candidates: int = 50
    first_stage: int = 50
    vector_weight: float = 0.3
    bm25_weight: float = 0.7
    rrf_k: int = fusion.RRF_K
    title_weight: float = 0.0
    per_document: int = 2


class Retriever:
    """Searches chunks (chunk_id, doc_id, text, optional title, company, ord and v).

    queries: query_id, query, and q (a vector) for routes that need one, unless
    ``encode`` makes vectors of texts (a Column function, e.g. a pandas UDF). segment:
    splits runs of ideographs (``text.bigrams`` without a dictionary, or any Column
    function from array to array); corpus and queries are segmented alike. score: the
    second stage's Column over query and text. Postings and term statistics are
    written once, when it is made; ``close`` deletes them and what searches wrote.
    """

    def __init__(
        self,
        chunks: DataFrame,
        settings: Settings | None = None,
        names: DataFrame | None = None,
        segment: Callable[[Column], Column] | None = T.bigrams,
        encode: Callable[[Column], Column] | None = None,
        score: Column | None = None,
    ):
        self.settings = settings or Settings()
        self.names, self.segment, self.encode, self.score = names, segment, encode, score
        self.has_vectors, self.has_titles = "v" in chunks.columns, "title" in chunks.columns
        keep = ["chunk_id", "doc_id", "text", *(c for c in ("v", "title", "company", "ord") if c in chunks.columns)]
        self._tables: list[DataFrame] = []
        self.chunks = self._written(chunks.select(*keep), "chunks")
        # postings are sorted by term: a search reads the row groups of its terms
        self.docs = self._written(lexical.postings(lexical.tokenized(self.chunks, "chunk_id", "text", segment)), "postings")
        self.stats = self._written(lexical.stats_of_postings(self.docs), "terms")
        self.heads = self._written(self._heads(), "heads") if self.has_titles else None
        self.head_docs = self._written(lexical.postings(self.heads), "head-postings") if self.has_titles else None
        self.head_stats = self._written(lexical.stats_of_postings(self.head_docs), "head-terms") if self.has_titles else None

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        self._tables.append(materialize(df, name))
        return self._tables[-1]

    def close(self) -> None:
        """Deletes all tables that it wrote; what its searches gave can't be read after that."""
        discard(*self._tables)
        self._tables = []

    @classmethod
    def load(cls, spark: SparkSession, path: str, **kwargs) -> Retriever:
        """From the tables that ``sources.writers.write_index`` made: indexed records with their vectors."""
        store = spark.read.parquet(f"{path}/docstore").where("indexed")
        vectors = spark.read.parquet(f"{path}/vectors")
        return cls(store.join(vectors, "docstore_id", "left").withColumn("chunk_id", F.col("docstore_id")), **kwargs)

    def _heads(self) -> DataFrame:
        """A row per document that has any: the tokens of its first title and company."""
        order = F.col("ord") if "ord" in self.chunks.columns else F.col("chunk_id")
        part = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) if c in self.chunks.columns else F.lit("")
        first = lambda c: F.coalesce(F.min_by(part(c), F.when(part(c) != "", order)), F.lit(""))
        heads = self.chunks.groupBy("doc_id").agg(first("title").alias("t"), first("company").alias("c"))
        heads = heads.select("doc_id", T.strip(F.concat_ws(" ", F.nullif("t", F.lit("")), F.nullif("c", F.lit("")))).alias("head"))
        return lexical.tokenized(heads, "doc_id", "head", self.segment).where(F.size("tokens") > 0)

    def warm_up(self) -> int:
        """Reads what every search reads; returns the number of chunks."""
        self.stats.count()
        return self.docs.select("id").distinct().count()

    def _terms(self, queries: DataFrame) -> DataFrame:
        return lexical.query_terms(queries, "query_id", "query", self.segment)

    def bm25(self, queries: DataFrame, k: int) -> DataFrame:
        terms = self._written(self._terms(queries), "query-terms")
        scores = lexical.scored(self.docs, terms, self.stats)
        if self.heads is not None and self.settings.title_weight:
            titles = lexical.scored(self.head_docs, terms, self.head_stats).withColumnRenamed("id", "doc_id").join(self.chunks.select("chunk_id", "doc_id"), "doc_id")
            scores = lexical.with_title_bonus(scores, titles.select("query_id", F.col("chunk_id").alias("id"), "score"), self.settings.title_weight)
        return lexical.top_k(scores, k)

    def vector(self, queries: DataFrame, k: int) -> DataFrame:
        if not self.has_vectors:
            raise ValueError("the chunks have no vectors (column v)")
        if self.encode is None and "q" not in queries.columns:
            raise ValueError("vector search needs a vector of each query (column q) or an encoder")
        asked = queries.select("query_id", self.encode(F.col("query")).alias("q")) if self.encode is not None else queries.select("query_id", "q")
        return dense.exact_top_k(self.chunks.select(F.col("chunk_id").alias("id"), "v").where("v IS NOT NULL"), asked, k)

    def _hits(self, queries: DataFrame, route: str, k: int, candidates: int) -> DataFrame:
        s = self.settings
        route = "hybrid_weightsum" if route == "hybrid" else route
        if route not in ROUTES:
            raise ValueError(f"route must be one of {', '.join(ROUTES)}")
        if route in ("bm25", "vector"):
            hits = self.bm25(queries, k) if route == "bm25" else self.vector(queries, k)
        else:
            both = fusion.merged(self.vector(queries, max(k, candidates)), self.bm25(queries, max(k, candidates)), candidates)
            hits = fusion.weighted_sum(both, s.vector_weight, s.bm25_weight, k) if route == "hybrid_weightsum" else fusion.reciprocal_rank(both, k, s.rrf_k)
        return hits.join(self.chunks.select(F.col("chunk_id").alias("id"), "doc_id"), "id").select("query_id", "rank", "id", "score", "doc_id")

    def search(self, queries: DataFrame, route: str = "hybrid_weightsum", k: int | None = None, decomposed: bool = False) -> DataFrame:
        """query_id, rank, id, score, doc_id of the ``k`` best chunks of each query; an unknown route raises.

        decomposed: queries that a plan takes apart are searched by branches, on the
        hybrid routes only; the others as they are.
        """
        k = self.settings.top_k if k is None else k
        if decomposed and route in HYBRID:
            return self._decomposed(queries, route, k, False, lambda rest: self._hits(rest, route, k, self.settings.candidates)).drop("query_type")
        return self._hits(queries, route, k, self.settings.candidates)

    def search_all(self, queries: DataFrame, k: int | None = None, reranked: bool = False) -> DataFrame:
        """Every route: route and what ``search`` gives, or ``two_stage`` if reranked.

        k holds for vector and BM25; the fused routes return their first stage's size.
        """
        found = None
        for route in ROUTES if self.has_vectors else ("bm25",):
            hits = self.two_stage(queries, route=route, k=k) if reranked else self.search(queries, route, self.settings.first_stage if route in HYBRID else k)
            hits = hits.withColumn("route", F.lit(route))
            found = hits if found is None else found.unionByName(hits)
        return found

    def _reranked(self, hits: DataFrame, queries: DataFrame, k: int | None, score: Column | None = None) -> DataFrame:
        """Hits by the second stage's score, each against the text of its own query (or branch)."""
        asked = F.array_distinct(T.tokens("query", self.segment))
        share = F.size(F.array_intersect(asked, T.tokens("text", self.segment))) / F.greatest(F.size(asked), F.lit(1))
        score = self.score if score is None else score
        keys = [c for c in ("query_id", "branch") if c in queries.columns]
        hits = hits.join(self.chunks.select(F.col("chunk_id").alias("id"), "text"), "id").join(queries.select(*keys, "query"), keys)
        rows = hits.withColumn("rerank_score", share if score is None else score)
        w = Window.partitionBy(*keys).orderBy(F.desc("rerank_score"), F.desc("score"), "id")
        rows = rows.withColumn("rank", F.row_number().over(w).cast("long"))
        return (rows if k is None else rows.where(F.col("rank") <= k)).drop("text", "query")

    def two_stage(self, queries: DataFrame, score: Column | None = None, route: str = "hybrid_weightsum", first: int | None = None, k: int | None = None, decomposed: bool = False) -> DataFrame:
        """The best ``first`` of a route, reranked by ``score`` over columns query and text (by default the share of query tokens held).

        decomposed: on any route, queries that a plan takes apart are searched by
        branches, and each branch is reranked by its own question.
        """
        k, first = self.settings.top_k if k is None else k, self.settings.first_stage if first is None else first
        plain = lambda rest: self._reranked(self._hits(rest, route, first, self.settings.candidates), rest, k, score)
        columns = ("query_id", "rank", "id", "doc_id", "score", "rerank_score")
        if decomposed:
            return self._decomposed(queries, route, k, True, plain, score).select(*columns)
        return plain(queries).select(*columns)

    def plans(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """query_id, query, plan: how each query would be taken apart; null plans are searched as they are."""
        if self.names is None:
            raise ValueError("decomposition needs a dictionary of names")
        return decompose.plan(queries, self.names, self.settings.top_k if k is None else k)

    def _decomposed(self, queries: DataFrame, route: str, k: int, reranked: bool, plain: Callable[[DataFrame], DataFrame], score: Column | None = None) -> DataFrame:
        """query_type and hits: branches of compare and summary plans merged; ``plain`` searches the queries without a plan.

        Branches of a kind of plan are one batch. A branch's candidates, its fusion's
        too, are as many as its plan says; each document gives at most ``per_document``.
        Vectors: by the encoder for each branch; without one, of branches the column
        ``branch_q`` (array of vectors, in order), or else the whole query's vector.
        """
        planned = self._written(self.plans(queries, k), "plans")
        branches = decompose.planned_branches(planned)
        given = [c for c in ("q", "branch_q") if c in queries.columns]
        if given:
            branches = branches.join(queries.select("query_id", *given), "query_id")
            vector = F.col("q") if "branch_q" not in given else F.get("branch_q", F.col("branch")) if "q" not in given else F.coalesce(F.get("branch_q", F.col("branch")), F.col("q"))
            branches = branches.withColumn("q", vector).drop("branch_q")
        branches = self._written(branches, "branches")
        found = plain(queries.join(branches.where("query_type = 'fact'").select("query_id"), "query_id", "left_semi")).withColumn("query_type", F.lit("fact"))
        columns = found.columns
        for kind, (_, candidates, output) in decompose.PLANS.items():
            mine = branches.where(F.col("query_type") == kind)
            # a branch is a query of its own: the pair of both numbers is its key
            asked = mine.withColumn("query_id", F.struct("query_id", "branch"))
            hits = self._hits(asked, route, candidates, candidates)
            hits = ranking.rerank_positions(ranking.per_group_cap(hits, ["query_id"], "doc_id", self.settings.per_document), ["query_id"])
            hits = hits.withColumn("branch", F.col("query_id.branch")).withColumn("query_id", F.col("query_id.query_id"))
            if reranked:
                hits = self._reranked(hits, mine, None, score)
            order = ("rerank_score", "score") if reranked else ("score",)
            merged = ranking.branch_union(hits, output, k, order) if kind == "compare" else ranking.quota_merge(hits, output - 1, 1, k, order)
            found = found.unionByName(merged.withColumn("query_type", F.lit(kind)).select(*columns))
        return found

    def search_decomposed(self, queries: DataFrame, route: str = "bm25") -> DataFrame:
        """query_id, query_type, rank, id, score, doc_id: branches of compare and summary plans merged, other queries as they are."""
        k = self.settings.top_k
        hits = self._decomposed(queries, route, k, False, lambda rest: self._hits(rest, route, k, self.settings.candidates))
        return hits.select("query_id", "query_type", "rank", "id", "score", "doc_id")
