"""Registered retrieval and evaluation queries, and the SQL each must equal.

Documents are the corpus, benchmark passages the queries; a document that contains a
passage is gold for it. Embeddings with a vec_id divisible by 50 are the vector queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators import dense, evaluation, fusion, lexical, ranking
from quillspark.plans.registry import ORACLE_SQL, QUERIES
from quillspark.session import materialize, read

K = 10
CANDIDATES = 20
_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\x{{4e00}}-\x{{9fff}}]+|[A-Za-z0-9._%+-]+')"


def _register(name: str, sql: str | None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return add


def _first_line_sql(column: str) -> str:
    return f"coalesce(list_filter(list_transform(string_split({column}, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')[1], '')"


def _bm25_sql(prefix: str, corpus: str, queries: str) -> str:
    """CTEs up to {prefix}top (query_id, rank, id, score); corpus: id, t; queries: query_id, t."""
    p = prefix
    tokens = _TOKENS.format("t")
    return f"""{p}docs AS (SELECT id, {tokens} AS tokens FROM ({corpus})),
{p}lens AS (SELECT id, len(tokens) AS dl FROM {p}docs),
{p}tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM {p}docs) GROUP BY id, term),
{p}n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(dl) / count(*) AS avgdl FROM {p}lens),
{p}raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM {p}tf GROUP BY term), {p}n),
{p}idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT sum(raw) / count(*) FROM {p}raw) ELSE raw END AS idf FROM {p}raw),
{p}q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens}) AS term FROM ({queries})) GROUP BY query_id, term),
{p}scores AS (SELECT query_id, tf.id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {p}q q JOIN {p}tf tf ON tf.term = q.term JOIN {p}idf i ON i.term = q.term JOIN {p}lens l ON l.id = tf.id, {p}n GROUP BY query_id, tf.id HAVING score > 0),
{p}top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM (SELECT query_id, id, round(score, 4) AS score FROM {p}scores))"""


_BODY = "SELECT doc_id AS id, text AS t FROM documents"
_HEAD = f"SELECT doc_id AS id, {_first_line_sql('text')} AS t FROM documents"
_ASKED = "SELECT item_id AS query_id, text AS t FROM benchmark"
_OUT = "SELECT query_id, CAST(rank AS BIGINT) AS rank, id, score FROM {0}"
_BOTH_SQL = f"""{_bm25_sql("b_", _BODY, _ASKED)},
{_bm25_sql("h_", _HEAD, _ASKED)},
a_norm AS (SELECT query_id, id, rank, CASE WHEN hi - lo < 1e-12 THEN CASE WHEN hi <= 0 THEN 0.0 ELSE 1.0 END ELSE (score - lo) / (hi - lo) END AS norm
  FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM b_top WHERE rank <= {CANDIDATES})),
c_norm AS (SELECT query_id, id, rank, CASE WHEN hi - lo < 1e-12 THEN CASE WHEN hi <= 0 THEN 0.0 ELSE 1.0 END ELSE (score - lo) / (hi - lo) END AS norm
  FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM h_top WHERE rank <= {CANDIDATES})),
fused AS (SELECT coalesce(a.query_id, c.query_id) AS query_id, coalesce(a.id, c.id) AS id, a.rank AS a_rank, a.norm AS a_norm, c.rank AS b_rank, c.norm AS b_norm
  FROM a_norm a FULL JOIN c_norm c ON a.query_id = c.query_id AND a.id = c.id)"""


def _rank_sql(score: str, by: str = "query_id") -> str:
    return f"SELECT {by}, CAST(row_number() OVER (PARTITION BY {by} ORDER BY score DESC, a_rank NULLS LAST, b_rank NULLS LAST, id) AS BIGINT) AS rank, id, score FROM (SELECT *, {score} AS score FROM fused) QUALIFY rank <= {K}"


def _docs(spark: SparkSession, sf: str, title: bool = False) -> DataFrame:
    """Tokens, made once and written: statistics, lengths and postings all read them."""
    docs = read(spark, sf, "documents")
    return materialize(lexical.tokenized(docs, "doc_id", T.first_nonempty_line("text") if title else F.col("text")), "tokens")


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.query_terms(read(spark, sf, "benchmark"), "item_id", "text")


def _body_hits(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    """Written, since what follows may read them more than once."""
    return materialize(lexical.best(_docs(spark, sf), _terms(spark, sf), k), "hits")


def _head_hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return materialize(lexical.best(_docs(spark, sf, True), _terms(spark, sf), k), "hits")


def _both(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.merged(_body_hits(spark, sf, CANDIDATES), _head_hits(spark, sf, CANDIDATES), CANDIDATES)


@_register("bm25_topk", f"WITH {_bm25_sql('', _BODY, _ASKED)} {_OUT.format('top')} WHERE rank <= {K}")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _body_hits(spark, sf)


@_register(
    "bm25_term_stats",
    f"WITH {_bm25_sql('', _BODY, _ASKED)} SELECT tf.term, count(*) AS df, round(any_value(idf), 6) AS idf FROM tf JOIN idf ON idf.term = tf.term GROUP BY tf.term",
)
def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.term_stats(_docs(spark, sf)).select("term", "df", F.round("idf", 6).alias("idf"))


@_register(
    "bm25_title_bonus",
    f"""WITH {_bm25_sql("b_", _BODY, _ASKED)}, {_bm25_sql("h_", _HEAD, _ASKED)},
both_ AS (SELECT coalesce(b.query_id, h.query_id) AS query_id, coalesce(b.id, h.id) AS id, round(coalesce(b.score, 0.0) + 0.5 * coalesce(h.score, 0.0), 4) AS score
  FROM b_scores b FULL JOIN h_scores h ON h.query_id = b.query_id AND h.id = b.id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS rank, id, score FROM both_ WHERE score > 0 QUALIFY rank <= {K}""",
)
def bm25_title_bonus(spark: SparkSession, sf: str) -> DataFrame:
    docs = lexical.tokenized(read(spark, sf, "documents"), "doc_id", "text", also={"title": T.tokens(T.first_nonempty_line("text"))})
    return lexical.best(materialize(docs, "tokens"), _terms(spark, sf), K, title=0.5)


@_register("hybrid_weighted", f"WITH {_BOTH_SQL} {_rank_sql('round(0.3 * coalesce(a_norm, 0.0) + 0.7 * coalesce(b_norm, 0.0), 6)')}")
def hybrid_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.weighted_sum(_both(spark, sf), 0.3, 0.7, K)


@_register("hybrid_rrf", f"WITH {_BOTH_SQL} {_rank_sql('round(coalesce(1.0 / (60 + a_rank), 0.0) + coalesce(1.0 / (60 + b_rank), 0.0), 6)')}")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.reciprocal_rank(_both(spark, sf), K)


WEIGHTS = [(0.2, 0.8), (0.3, 0.7), (0.4, 0.6), (0.5, 0.5)]
CONSTANTS = [10, 30, 50, 60, 80]
_SETTINGS = ", ".join([f"('weighted({a}/{b})', {a}, {b}, NULL)" for a, b in WEIGHTS] + [f"('rrf({c})', NULL, NULL, {c})" for c in CONSTANTS])


@_register(
    "fusion_sweep",
    f"""WITH {_BOTH_SQL}, settings(setting, wa, wb, c) AS (VALUES {_SETTINGS}),
scored AS (SELECT *, round(CASE WHEN c IS NULL THEN CAST(wa AS DOUBLE) * coalesce(a_norm, 0.0) + CAST(wb AS DOUBLE) * coalesce(b_norm, 0.0)
  ELSE coalesce(1.0 / (c + a_rank), 0.0) + coalesce(1.0 / (c + b_rank), 0.0) END, 6) AS score FROM fused, settings)
SELECT setting, query_id, CAST(row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, a_rank NULLS LAST, b_rank NULLS LAST, id) AS BIGINT) AS rank, id, score
FROM scored QUALIFY rank <= {K}""",
)
def fusion_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.sweep(materialize(_both(spark, sf), "candidates"), WEIGHTS, CONSTANTS, K)


_GOLD_SQL = "gold AS (SELECT b.item_id AS query_id, 0 AS component, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_CAP_SQL = f"""WITH {_bm25_sql('', _BODY, _ASKED)}, hits AS (SELECT t.*, d.source FROM top t JOIN documents d ON d.doc_id = t.id WHERE rank <= 50),
capped AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS rank, id, source, score FROM capped QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {K}"""


@_register("per_source_cap", _CAP_SQL)
def per_source_cap(spark: SparkSession, sf: str) -> DataFrame:
    hits = _body_hits(spark, sf, 50).join(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    capped = ranking.rerank_positions(ranking.per_group_cap(hits, ["query_id"], "source", 2), ["query_id"])
    return capped.where(F.col("rank") <= K).select("query_id", "rank", "id", "source", "score")


#: Passages up to which every document is searched for all of them; beyond, they meet by five of their words.
BROADCAST_PASSAGES = 1000


def gold(spark: SparkSession, sf: str, most: int = BROADCAST_PASSAGES) -> DataFrame:
    """query_id, component, id: the documents that contain a passage; written, so that metrics that read it twice don't search twice."""
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    rows = containing(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), items, most)
    return materialize(rows.select("query_id", F.lit(0).alias("component"), "id"), "gold")


def containing(docs: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """docs (id, text) joined with the items (query_id, passage) that their texts contain.

    Of more than ``most`` items those of seven words and more meet documents by their
    second to sixth word, which stand whole in any text that contains them; the rest of
    them, of at most six words each, are few kinds of text and are broadcast.
    """
    held = F.col("text").contains(F.col("passage"))
    if items.count() <= most:
        return docs.join(F.broadcast(items), held)
    five = lambda words, i: F.xxhash64(F.array_join(F.slice(words, i, 5), " "))
    words = lambda c: F.split(F.col(c), r"\s+")
    long = F.size(words("passage")) >= 7
    keyed = items.where(long).withColumn("key", five(words("passage"), F.lit(2)))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words("text")) - 4, F.lit(1))), lambda i: five(words("text"), i))
    met = docs.select("id", F.explode(F.array_distinct(every)).alias("key")).join(keyed.select("key", "query_id", "passage"), "key")
    found = met.select("id", "query_id", "passage").join(docs, "id").where(held)
    return found.select("id", "text", "query_id", "passage").unionByName(docs.join(F.broadcast(items.where(~long)), held))


_TWO_SQL = """two AS (SELECT query_id // 2 AS query_id, query_id % 2 AS component, id FROM gold),
hits2 AS (SELECT query_id // 2 AS query_id, id, min(rank) AS rank FROM top WHERE rank <= 10 GROUP BY 1, 2),
ranked2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS rank FROM hits2),
firsts AS (SELECT g.query_id, g.component, min(h.rank) AS first FROM two g LEFT JOIN ranked2 h ON h.query_id = g.query_id AND h.id = g.id GROUP BY 1, 2),
per_query AS (SELECT query_id, CASE WHEN count(first) = count(*) THEN max(first) END AS whole, count(*) FILTER (first <= 10) AS found, count(*) AS n FROM firsts GROUP BY 1),
gains AS (SELECT h.query_id, h.id, min(h.rank) AS rank, count(DISTINCT component) AS gain FROM ranked2 h JOIN two g ON g.query_id = h.query_id AND g.id = h.id WHERE h.rank <= 10 GROUP BY 1, 2),
ideal AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank) AS best FROM gains),
ndcg AS (SELECT query_id, round(sum(gain / log2(rank + 1)) / sum(gain / log2(best + 1)), 6) AS ndcg_local FROM ideal GROUP BY 1),
metrics AS (SELECT p.query_id, coalesce(CAST(whole <= 3 AS DOUBLE), 0.0) AS recall_at_3, coalesce(CAST(whole <= 5 AS DOUBLE), 0.0) AS recall_at_5, coalesce(CAST(whole <= 10 AS DOUBLE), 0.0) AS recall_at_10,
  round(coalesce(CASE WHEN whole <= 10 THEN 1.0 / whole END, 0.0), 6) AS mrr, round(found / n, 6) AS partial_hit, CAST(found > 0 AS DOUBLE) AS any_hit, coalesce(ndcg_local, 0.0) AS ndcg_local
  FROM per_query p LEFT JOIN ndcg ON ndcg.query_id = p.query_id)"""


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two passages make one query with two components; hits are merged by best rank."""
    half = F.expr("query_id DIV 2").alias("query_id")
    known = gold(spark, sf).select(half, (F.col("query_id") % 2).cast("int").alias("component"), "id")
    hits = _body_hits(spark, sf).select(half, "id", "rank").groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))), known


@_register("grouped_metrics", f"WITH {_bm25_sql('', _BODY, _ASKED)}, {_GOLD_SQL}, {_TWO_SQL} SELECT * FROM metrics")
def grouped_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.grouped_metrics(*_pairs(spark, sf))


@_register(
    "metrics_rollup",
    f"""WITH {_bm25_sql('', _BODY, _ASKED)}, {_GOLD_SQL}, {_TWO_SQL}, typed AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS query_type FROM metrics)
SELECT coalesce(query_type, 'average') AS query_type, count(*) AS n, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr, round(avg(ndcg_local), 6) AS ndcg_local,
  count(recall_at_10) AS n_recall_at_10, count(mrr) AS n_mrr, count(ndcg_local) AS n_ndcg_local FROM typed GROUP BY ROLLUP (query_type)""",
)
def metrics_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.grouped_metrics(*_pairs(spark, sf)).withColumn("query_type", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    return evaluation.rollup_means(rows, "query_type", ["recall_at_10", "mrr", "ndcg_local"])


@_register(
    "strict_recall",
    f"""WITH {_bm25_sql('', _BODY, _ASKED)}, {_GOLD_SQL}, firsts AS (SELECT g.query_id, g.id, min(h.rank) AS first FROM gold g LEFT JOIN (SELECT * FROM top WHERE rank <= {K}) h ON h.query_id = g.query_id AND h.id = g.id GROUP BY 1, 2)
SELECT query_id, {", ".join(f"CASE WHEN count(first) = count(*) AND max(first) <= {c} THEN CAST(1 AS BIGINT) ELSE 0 END AS hit_at_{c}" for c in (3, 5, 10))} FROM firsts GROUP BY query_id""",
)
def strict_recall(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.strict_hits(_body_hits(spark, sf), gold(spark, sf))


@_register(
    "first_match_rank",
    f"""WITH {_bm25_sql('', _BODY, _ASKED)}, {_GOLD_SQL} SELECT g.query_id, round(coalesce(1.0 / min(h.rank), 0.0), 6) AS rr
FROM gold g LEFT JOIN (SELECT * FROM top WHERE rank <= {K}) h ON h.query_id = g.query_id AND h.id = g.id GROUP BY 1""",
)
def first_match_rank(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.first_match(_body_hits(spark, sf), gold(spark, sf))


_UNIT = "unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 1e-12)) AS v FROM embeddings)"
_DENSE = f"{_UNIT}, near AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_dot_product(q.v, d.v), 6) AS score FROM unit q JOIN unit d ON q.vec_id % 50 = 0), hits AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS rank, id, score FROM near QUALIFY rank <= {K})"


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return rows, rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


@_register("dense_topk", f"WITH {_DENSE} SELECT * FROM hits")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.exact_top_k(*_vectors(spark, sf), K)


@_register(
    "knn_label_vote",
    f"""WITH {_DENSE}, votes AS (SELECT h.query_id, e.label, count(*) AS n FROM hits h JOIN embeddings e ON e.vec_id = h.id WHERE h.id <> h.query_id GROUP BY 1, 2)
SELECT query_id, label, n FROM votes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1""",
)
def knn_label_vote(spark: SparkSession, sf: str) -> DataFrame:
    rows, queries = _vectors(spark, sf)
    votes = dense.exact_top_k(rows, queries, K).where("id != query_id").join(rows.select("id", "label"), "id").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "label")
    return votes.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


@_register("l2_normalize", f"WITH {_UNIT} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1], 6) AS first FROM unit")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("u")
    rows = read(spark, sf, "embeddings").select("vec_id", dense.l2_normalize("embedding").alias("u"))
    return rows.select("vec_id", F.round(dense.dot(v, v), 6).alias("norm"), F.round(F.get(v, 0), 6).alias("first"))


_IVF = f"""{_UNIT}, means AS (SELECT label AS list_id, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
cents AS (SELECT list_id, list_transform(c, lambda x: x / greatest(sqrt(list_sum(list_transform(c, lambda y: y * y))), 1e-12)) AS c FROM means),
placed AS (SELECT vec_id, v, list_id FROM unit, cents QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(v, c), 9) DESC, list_id) = 1),
probed AS (SELECT vec_id AS query_id, v AS q, list_id FROM unit, cents WHERE vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(v, c), 9) DESC, list_id) <= 16),
ivf AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS rank, id, score
  FROM (SELECT query_id, vec_id AS id, round(list_dot_product(q, v), 6) AS score FROM placed JOIN probed USING (list_id)) QUALIFY rank <= {K})"""


def _ivf(spark: SparkSession, sf: str) -> DataFrame:
    rows, queries = _vectors(spark, sf)
    return dense.ivf_top_k(rows, queries, materialize(dense.list_means(rows, "label", "v"), "centroids"), K)


@_register("ivf_topk", f"WITH {_IVF} SELECT * FROM ivf")
def ivf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ivf(spark, sf)


@_register(
    "ann_overlap",
    f"""WITH {_IVF}, near AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_dot_product(q.v, d.v), 6) AS score FROM unit q JOIN unit d ON q.vec_id % 50 = 0),
hits AS (SELECT query_id, id FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {K})
SELECT h.query_id, round(count(i.id) / {K}, 6) AS overlap FROM hits h LEFT JOIN ivf i ON i.query_id = h.query_id AND i.id = h.id GROUP BY 1""",
)
def ann_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return dense.overlap(_ivf(spark, sf), dense.exact_top_k(*_vectors(spark, sf), K), K)


# Two sources and a passage make a compare query, three a summary query: a branch for each source.
_BRANCH_SQL = """asked AS (SELECT item_id AS query_id, text AS t FROM benchmark),
branches AS (SELECT query_id, b AS branch, 'src' || ((query_id + b) % 20) AS source FROM asked, range(3) r(b)),
hits AS (SELECT t.query_id, br.branch, t.id, t.score, row_number() OVER (PARTITION BY t.query_id, br.branch ORDER BY t.score DESC, t.id) AS rank
  FROM (SELECT query_id, id, round(score, 4) AS score FROM scores) t JOIN documents d ON d.doc_id = t.id JOIN branches br ON br.query_id = t.query_id AND br.source = d.source)"""


def _branch_hits(spark: SparkSession, sf: str) -> DataFrame:
    docs = materialize(lexical.tokenized(read(spark, sf, "documents"), "doc_id", "text", also={"group": F.col("source")}), "tokens")
    branches = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("branch"))
    branches = branches.withColumn("group", F.concat(F.lit("src"), ((F.col("query_id") + F.col("branch")) % 20).cast("string")))
    hits = lexical.best(docs, _terms(spark, sf), 15, groups=branches.select("query_id", "group")).join(F.broadcast(branches), ["query_id", "group"])
    return materialize(hits.select("query_id", F.col("branch").cast("long").alias("branch"), "id", "score", "rank"), "hits")


@_register(
    "decompose_compare",
    f"""WITH {_bm25_sql('', _BODY, _ASKED)}, {_BRANCH_SQL}, kept AS (SELECT * FROM hits WHERE branch < 2 AND rank <= 5 QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY branch, rank) = 1)
SELECT query_id, branch, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS rank FROM kept QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {K}""",
)
def decompose_compare(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.branch_union(_branch_hits(spark, sf).where("branch < 2"), 5, K)


@_register(
    "decompose_summary",
    f"""WITH {_bm25_sql('', _BODY, _ASKED)}, {_BRANCH_SQL}, short AS (SELECT * FROM hits WHERE rank <= 15),
first3 AS (SELECT * FROM short WHERE rank <= 3 QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY branch, rank) = 1),
rest AS (SELECT s.* FROM short s ANTI JOIN first3 f ON f.query_id = s.query_id AND f.id = s.id WHERE s.rank > 3 QUALIFY row_number() OVER (PARTITION BY s.query_id, s.id ORDER BY branch, rank) = 1),
extra AS (SELECT * FROM rest QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, branch, id) <= 1), total AS (SELECT * FROM first3 UNION ALL SELECT * FROM extra)
SELECT query_id, branch, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS rank FROM total QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {K}""",
)
def decompose_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.quota_merge(_branch_hits(spark, sf), 3, 1, K)


@_register(
    "rerank_lexical",
    f"""WITH {_bm25_sql('', _BODY, _ASKED)}, pool AS (SELECT t.*, d.text, b.text AS query FROM top t JOIN documents d ON d.doc_id = t.id JOIN benchmark b ON b.item_id = t.query_id WHERE rank <= 50),
scored AS (SELECT query_id, id, score, round(len(list_intersect(list_distinct({_TOKENS.format('query')}), list_distinct({_TOKENS.format('text')}))) / greatest(len(list_distinct({_TOKENS.format('query')})), 1), 6) AS rerank_score FROM pool)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, id) AS BIGINT) AS rank, id, rerank_score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, id) <= {K}""",
)
def rerank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """Two stages: the best 50 by BM25, then by the share of query tokens they hold (the model-free default scorer)."""
    pool = _body_hits(spark, sf, 50).join(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    pool = pool.join(read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    asked = F.array_distinct(T.tokens("query"))
    share = F.round(F.size(F.array_intersect(asked, T.tokens("text"))) / F.greatest(F.size(asked), F.lit(1)), 6)
    return ranking.rerank(pool, share, K).select("query_id", "rank", "id", "rerank_score")
