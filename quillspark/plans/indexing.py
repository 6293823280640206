"""Registered queries on dictionaries, names and changing indexes, and the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import segment
from quillspark.operators import decompose, lexical
from quillspark.operators.embedding import EmbeddingStore
from quillspark.plans.parsing import _HAN, _LATIN
from quillspark.plans.retrieval import _ASKED, _bm25_sql, K, _register, _terms
from quillspark.session import new_path, read
from quillspark.streaming import incremental
from quillspark.streaming.segments import SegmentedIndex

# Documents arrive in two lots; the second brings new versions too; some go, some of those come back.
_CHANGED = "SELECT doc_id AS id, CASE WHEN doc_id % 22 <> 0 AND doc_id % 7 = 0 THEN source || ' ' || text ELSE text END AS t FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 22 = 0"


@_register("segmented_search", f"WITH {_bm25_sql('', _CHANGED, _ASKED)} SELECT query_id, CAST(rank AS BIGINT) AS rank, id, score FROM top WHERE rank <= {K}")
def segmented_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search over an index that has seen additions, new versions, deletions, a compaction and a return."""
    docs = read(spark, sf, "documents").select("doc_id", "text", "source")
    index = SegmentedIndex(spark, new_path(spark, "index"))
    index.add(docs.where("doc_id % 3 != 1"), "first")
    index.add(docs.where("doc_id % 3 = 1 OR doc_id % 7 = 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat_ws(" ", "source", "text")).otherwise(F.col("text"))), "second")
    index.delete(docs.where("doc_id % 11 = 0"), "third")
    index.compact()
    index.add(docs.where("doc_id % 22 = 0"), "fourth")
    index.vacuum()
    return index.search(_terms(spark, sf), K)


# Names of parts as runs of ideographs; the dictionary has their words and, to be ambiguous, the words' first three letters.
_RUNS = f"SELECT p_partkey AS id, translate(lower(p_name), '{_LATIN}', '{_HAN}') AS t FROM part"
_BLANK = _HAN[len(_LATIN) - 1]
_COUNTS = f"""SELECT w, count(*) AS n FROM (SELECT unnest(string_split(t, '{_BLANK}')) AS w FROM ({_RUNS})) WHERE w <> '' GROUP BY w"""


@_register(
    "bm25_dictionary",
    f"""WITH RECURSIVE names AS ({_RUNS}), counts AS ({_COUNTS}), dict AS (SELECT w, max(n) AS n FROM (SELECT * FROM counts UNION ALL SELECT substr(w, 1, 3), n FROM counts) GROUP BY w),
held AS (SELECT ln(sum(n)) AS total, max(length(w)) AS longest FROM dict), m AS (SELECT map(list(w), list(ln(n) - total)) AS d, any_value(total) AS total, any_value(longest) AS longest FROM dict, held),
dp(t, i, best, parts) AS (SELECT DISTINCT t, length(t) + 1, [CAST(0 AS DOUBLE)], [CAST([] AS VARCHAR[])] FROM names UNION ALL
  SELECT t, i - 1, list_prepend(x.s, best), list_prepend(list_concat([substr(t, i - 1, x.k)], parts[x.k]), parts) FROM (SELECT t, i, best, parts, list_sort(list_filter(list_transform(range(1, least(longest, length(t) - i + 2) + 1),
    lambda k: {{'s': coalesce(d[substr(t, i - 1, k)], CASE WHEN k = 1 THEN -total END) + best[k], 'k': k}}), lambda x: x.s IS NOT NULL), 'DESC')[1] AS x FROM dp, m WHERE i > 1)),
docs AS (SELECT id, parts[1] AS tokens FROM names JOIN dp USING (t) WHERE i = 1),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM docs) GROUP BY id, term), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(len(tokens)) / count(*) AS avgdl FROM docs),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT sum(raw) / count(*) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT id AS query_id, term, count(*) AS qtf FROM docs, unnest(tokens) u(term) WHERE id % 50 = 0 GROUP BY id, term),
s AS (SELECT query_id, tf.id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl))), 4) AS score FROM q JOIN tf ON tf.term = q.term JOIN idf ON idf.term = q.term JOIN docs ON docs.id = tf.id, n GROUP BY query_id, tf.id HAVING sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl))) > 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS rank, id, score FROM s QUALIFY rank <= {K}""",
)
def bm25_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Search among runs of ideographs that a dictionary splits; every part whose key is divisible by 50 is a query."""
    names = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.translate(F.lower("p_name"), _LATIN, _HAN).alias("t"))
    counts = names.select(F.explode(F.split("t", _BLANK)).alias("w")).where("w != ''").groupBy("w").agg(F.count("*").alias("n"))
    words = counts.unionByName(counts.select(F.left("w", F.lit(3)).alias("w"), "n")).groupBy(F.col("w").alias("word")).agg(F.max("n").alias("n"))
    split = segment.segmenter(segment.dictionary_of(words))
    return lexical.best_of_texts(names, names.where("id % 50 = 0").withColumnRenamed("id", "query_id"), K, split)


_KNOWN = "SELECT DISTINCT name FROM (SELECT unnest([w, substr(w, 2, 3), substr(w, 1, 1) || 'e', p || ' ' || w]) AS name FROM (SELECT unnest(x) AS w, x[1] AS p FROM (SELECT string_split(p_name, ' ') AS x FROM part))) WHERE name <> ''"


@_register(
    "names_in_texts",
    f"""WITH RECURSIVE texts AS (SELECT DISTINCT p_name AS t FROM part), known AS ({_KNOWN}),
m AS (SELECT t, name, instr(t, name) AS s, instr(t, name) + length(name) AS e, row_number() OVER (PARTITION BY t ORDER BY length(name) DESC, name) AS r FROM texts JOIN known ON contains(t, name)),
f(t, r, used) AS (SELECT t, 0, CAST([] AS STRUCT(s BIGINT, e BIGINT, n VARCHAR)[]) FROM texts UNION ALL
  SELECT f.t, f.r + 1, CASE WHEN len(list_filter(used, lambda u: m.s < u.e AND u.s < m.e)) = 0 THEN list_append(used, {{'s': m.s, 'e': m.e, 'n': m.name}}) ELSE used END FROM f JOIN m ON m.t = f.t AND m.r = f.r + 1)
SELECT p_partkey, array_to_string(list_transform(list_sort(used), lambda u: u.n), '|') AS names FROM part JOIN (SELECT t, used FROM f QUALIFY row_number() OVER (PARTITION BY t ORDER BY r DESC) = 1) ON t = p_name""",
)
def names_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The names that each part's name holds, of words, pieces of words and pairs of words; longest first, none over another."""
    parts = read(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text"))
    x = F.split("text", " ")
    words = parts.select(F.explode(x).alias("w"), F.get(x, 0).alias("p"))
    names = words.select(F.explode(F.array("w", F.substring("w", 2, 3), F.concat(F.left("w", F.lit(1)), F.lit("e")), F.concat_ws(" ", "p", "w"))).alias("name"))
    found = parts.join(decompose.names_in(parts, names), "text", "left")
    return found.select("p_partkey", F.array_join(F.coalesce("entities", F.array().cast("array<string>")), "|").alias("names"))


LETTERS = "abcdefghij"


def _letter_counts():
    import numpy as np

    return lambda texts: np.array([[t.count(c) for c in LETTERS] for t in texts], np.float32).reshape(len(texts), len(LETTERS))


_COUNT_SQL = "[" + ", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in LETTERS) + "]"


@_register(
    "embedding_store",
    f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN source || text ELSE text END AS t FROM documents) SELECT doc_id, md5(array_to_string({_COUNT_SQL}, ',')) AS digest, (SELECT count(DISTINCT t) FROM d WHERE t NOT IN (SELECT text FROM documents WHERE text IS NOT NULL)) AS encoded FROM d",
)
def embedding_store(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of documents of which a fifth changed after they had been encoded; encoded: how many texts the second run had to encode."""
    docs = read(spark, sf, "documents").select("doc_id", "text", "source")
    store = EmbeddingStore(spark, new_path(spark, "vectors"), "letters", _letter_counts)
    store.add(docs)
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("source", "text")).otherwise(F.col("text")))
    n = store.add(changed)
    counts = F.array_join(F.transform("v", lambda x: x.cast("long").cast("string")), ",")
    return store.vectors(changed).select("doc_id", F.md5(counts).alias("digest"), F.lit(n).cast("long").alias("encoded"))


@_register(
    "user_sessions",
    """WITH e AS (SELECT user_id, ts, value, coalesce(ts >= lag(ts) OVER w + INTERVAL 10 MINUTE, true) AS begins FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM e)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts) + INTERVAL 10 MINUTE) AS BIGINT) AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, no""",
)
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users, by gaps of ten minutes between their events."""
    rows = incremental.user_sessions(read(spark, sf, "events"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.select("user_id", us("start").alias("start_us"), us("end").alias("end_us"), "n", "total")
