"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import compaction, forest, jaccard, leaks, licenses, maxscore, packing, passages, pieces, quality, urllists, variants, warc
from quillspark.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


QUERIES["op6_best_fit_packing"] = op6_best_fit_packing


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


QUERIES["op4_ngram_jaccard_join"] = op4_ngram_jaccard_join


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["op7_quality_classifier"] = op7_quality_classifier


def op10_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


QUERIES["op10_sentencepiece_codec"] = op10_sentencepiece_codec


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.cut_repeats(read(spark, sf_dir, "documents"))


QUERIES["op8_substring_dedup"] = op8_substring_dedup


def op1_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return maxscore.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


QUERIES["op1_maxscore_topk"] = op1_maxscore_topk
ORACLE_SQL["op1_maxscore_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(read(spark, sf_dir, "embeddings"))


QUERIES["op9_embedding_near_dedup"] = op9_embedding_near_dedup


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"))


QUERIES["op3_warc_salvage"] = op3_warc_salvage


#: Words of which the lists' domains are made: each first word, then each second, under each suffix.
FIRST_WORDS = (
    "adult", "bargain", "best", "bets", "bonus", "cash", "casino", "cheap", "click", "coupon", "crypto", "dating", "deal", "diet", "fake",
    "fast", "free", "gambling", "gift", "hot", "loan", "lucky", "pills", "poker", "spam",
)
SECOND_WORDS = (
    "bets", "bonus", "cash", "casino", "chat", "click", "club", "coins", "deals", "farm", "gifts", "loans", "meds", "money", "offers",
    "pills", "poker", "prizes", "shop", "slots", "spam", "store", "win", "world", "x",
)
SUFFIXES = ("example.com", "example.net", "example.org")
LISTED = len(FIRST_WORDS) * len(SECOND_WORDS) * len(SUFFIXES)


def _list_events(first: Callable[[str, str], str], day: Callable[[str], str]) -> str:
    """The lists' history as SQL over ``listed`` (n): thousands of dated events by a rule.

    Domain n is of one of five blocklists; it is added on a day of 2024, every third
    is removed later, and every sixth comes back. Every seventh domain's page /en is
    listed too, as a full URL, and subdomains "m." of every eleventh are allowed for a time.
    """
    words = lambda values, at: first(", ".join(repr(v) for v in values), at)
    x, y = len(FIRST_WORDS), len(SECOND_WORDS)
    named = (
        f"SELECT n, {words(FIRST_WORDS, f'n % {x}')} || '-' || {words(SECOND_WORDS, f'CAST(floor(n / {x}) AS INT) % {y}')}"
        f" || '.' || {words(SUFFIXES, f'CAST(floor(n / {x * y}) AS INT)')} AS d FROM listed"
    )
    event = lambda name, policy, kind, entry, action, on, where: f"SELECT {name} AS list_name, '{policy}' AS policy, '{kind}' AS kind, {entry} AS entry, '{action}' AS action, {day(on)} AS listed_on FROM named WHERE {where}"
    of = "'list' || CAST(n % 5 AS STRING)"
    return f"""WITH named AS ({named}) """ + " UNION ALL ".join(
        [
            event(of, "block", "domain", "d", "add", "n * 37 % 240", "n >= 0"),
            event(of, "block", "domain", "d", "remove", "n * 37 % 240 + 20 + n % 50", "n % 3 = 0"),
            event(of, "block", "domain", "d", "add", "n * 37 % 240 + 80 + n % 40", "n % 6 = 0"),
            event("'pages'", "block", "page", "'https://www.' || d || '/en/' || CAST(n AS STRING) || '#top'", "add", "n % 30", "n % 7 = 0"),
            event("'trusted'", "allow", "domain", "'m.' || d", "add", "n % 100", "n % 11 = 0"),
            event("'trusted'", "allow", "domain", "'m.' || d", "remove", "n % 100 + 150", "n % 22 = 0"),
        ]
    )


def _crawl_events(day: Callable[[str], str]) -> str:
    """Events that the crawl itself gave, as SQL over ``pages``: pages taken down, some for forty days, and hosts of partners, in capitals."""
    event = lambda name, policy, kind, entry, action, on, where: f"SELECT '{name}' AS list_name, '{policy}' AS policy, '{kind}' AS kind, {entry} AS entry, '{action}' AS action, {day(on)} AS listed_on FROM pages WHERE {where}"
    return " UNION ALL ".join(
        [
            event("takedowns", "block", "page", "url", "add", "page_id * 7 % 300", "page_id % 9 = 0"),
            event("takedowns", "block", "page", "url", "remove", "page_id * 7 % 300 + 40", "page_id % 18 = 0"),
            event("partners", "allow", "domain", "upper(split_part(url, '/', 3))", "add", "page_id * 11 % 200", "page_id % 23 = 0"),
            event("partners", "allow", "domain", "upper(split_part(url, '/', 3))", "remove", "page_id * 11 % 200 + 90", "page_id % 46 = 0"),
        ]
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture's day follows from its page_id, as the table has none."""
    sql = _list_events(lambda values, at: f"element_at(array({values}), {at} + 1)", lambda n: f"date_add(DATE '2024-01-01', CAST({n} AS INT))")
    events = spark.sql(sql.replace("FROM listed", "FROM (SELECT CAST(id AS INT) AS n FROM range({n}))"), n=LISTED)
    pages = read(spark, sf_dir, "pages")
    crawl = _crawl_events(lambda n: f"date_add(DATE '2024-01-01', CAST({n} AS INT))")
    events = events.unionByName(spark.sql(crawl.replace("FROM pages", "FROM {pages}"), pages=pages))
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched_on"))
    return urllists.match_lists(captures, events).withColumn("fetched_on", F.col("fetched_on").cast("string"))


QUERIES["op2_url_filters"] = op2_url_filters
_EVENTS_SQL = _list_events(lambda values, at: f"[{values}][{at} + 1]", lambda n: f"DATE '2024-01-01' + CAST({n} AS INTEGER)").replace("AS STRING", "AS VARCHAR")
ORACLE_SQL["op2_url_filters"] = f"""
WITH listed AS (SELECT CAST(i AS INTEGER) AS n FROM range({LISTED}) r(i)), events AS (SELECT * FROM ({_EVENTS_SQL}) UNION ALL {_crawl_events(lambda n: f"DATE '2024-01-01' + CAST({n} AS INTEGER)")}),
spans AS (SELECT *, lead(listed_on) OVER (PARTITION BY list_name, policy, kind, entry ORDER BY listed_on, action) AS until FROM events),
named AS (SELECT *, CASE WHEN kind = 'page' THEN rtrim(regexp_extract(lower(entry), '{urllists.HOST}', 1), '.') || rtrim(regexp_extract(entry, '(?i){urllists.PATH}', 1), '/') ELSE lower(entry) END AS e FROM spans),
captures AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on,
    nullif(rtrim(regexp_extract(lower(url), '{urllists.HOST}', 1), '.'), '') AS host, rtrim(regexp_extract(url, '(?i){urllists.PATH}', 1), '/') AS path
  FROM pages
), above AS (SELECT host, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS domain FROM (SELECT DISTINCT host FROM captures)),
pairs AS (
  SELECT c.page_id, s.list_name, s.policy FROM captures c JOIN above a ON a.host = c.host JOIN named s ON s.kind = 'domain' AND s.e = a.domain
  AND s.action = 'add' AND s.listed_on <= c.fetched_on AND (s.until IS NULL OR c.fetched_on < s.until)
  UNION ALL SELECT c.page_id, s.list_name, s.policy FROM captures c JOIN named s ON s.kind = 'page' AND s.e = c.host || c.path
  AND s.action = 'add' AND s.listed_on <= c.fetched_on AND (s.until IS NULL OR c.fetched_on < s.until)
)
SELECT c.page_id, any_value(c.host) AS host, CAST(any_value(c.fetched_on) AS VARCHAR) AS fetched_on, count(h.list_name) AS n_entries,
  coalesce(string_agg(DISTINCT h.list_name, ',' ORDER BY h.list_name), '') AS lists,
  coalesce(bool_or(h.policy = 'block'), false) AND NOT coalesce(bool_or(h.policy = 'allow'), false) AS blocked
FROM captures c LEFT JOIN pairs h ON h.page_id = c.page_id GROUP BY c.page_id
"""

#: Documents as files of a tree: their repository is the source; one in 25 is a licence file, of its folder or the one above.
_FILE_DIR = "concat_ws('/', source, lang, concat('p', cast(doc_id % 97 AS string)))"
_FILE_PATH = f"CASE WHEN doc_id % 50 = 0 THEN concat_ws('/', source, lang, 'LICENSE') WHEN doc_id % 25 = 0 THEN concat({_FILE_DIR}, '/LICENSE.txt') ELSE concat({_FILE_DIR}, '/', cast(doc_id AS string), '.txt') END"


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents").select("doc_id", F.expr(_FILE_PATH).alias("path"), "text"))


QUERIES["op5_license_scans"] = op5_license_scans
ORACLE_SQL["op5_license_scans"] = licenses.oracle(f"SELECT doc_id, {_FILE_PATH} AS path, text FROM documents")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read(spark, sf_dir, "documents"))


QUERIES["op11_spelling_variants"] = op11_spelling_variants


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


QUERIES["op12_benchmark_decontamination"] = op12_benchmark_decontamination
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = "regexp_extract_all(" + _FOLD + ", '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')"
ORACLE_SQL["op12_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, coalesce({_SPLIT.format('text')}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (
  SELECT a.doc_id, a.i, x.size, x.item FROM (SELECT a.doc_id, a.i, s.size, array_to_string(a.w[a.i : a.i + s.size - 1], ' ') AS win FROM spots a JOIN (SELECT DISTINCT size FROM windows) s ON a.i + s.size - 1 <= len(a.w)) a
  JOIN windows x USING (size, win)
), marked AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op13_bin_packed_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compact_table(read(spark, sf_dir, "clicks"))


QUERIES["op13_bin_packed_compaction"] = op13_bin_packed_compaction
