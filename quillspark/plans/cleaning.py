"""Registered text, block, table, chunk and answer queries, and the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators import blocks, chunking, decompose, evaluation, evidence, lexical, tables
from quillspark.plans.retrieval import _ASKED, _BODY, _TOKENS, K, _bm25_sql, _body_hits, _register
from quillspark.session import materialize, read

_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))"
_COUNTED = r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)?|[^\s]"
_COUNT = "len(regexp_extract_all({0}, '" + _COUNTED.replace("{", "{{").replace("}", "}}") + "'))"
_LINES = "SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS text FROM documents"
_KEY = rf"regexp_replace({_CLEAN.format('text')}, '\d+', '#', 'g')"


@_register("text_clean", f"SELECT doc_id, length({_CLEAN.format('text')}) AS n, md5({_CLEAN.format('text')}) AS digest FROM documents")
def text_clean(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.clean_text("text").alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@_register("token_stats", f"SELECT doc_id, {_COUNT.format('text')} AS n_tokens, len({_TOKENS.format('text')}) AS n_terms, len(list_distinct({_TOKENS.format('text')})) AS n_distinct FROM documents")
def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = T.tokens("text")
    return read(spark, sf, "documents").select(
        "doc_id", T.token_count("text").alias("n_tokens"), F.size(t).cast("long").alias("n_terms"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct")
    )


@_register(
    "sentence_split",
    f"""SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (SELECT doc_id,
  list_filter(string_split(regexp_replace(text, '([。！？!?；;])', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_CLEAN.format('x')} <> '') AS s FROM documents)""",
)
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select("doc_id", T.split_sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.lines_as_blocks(read(spark, sf, "documents"), "doc_id", "text", "source")


@_register(
    "repeated_edges",
    f"""SELECT source, key, count(*) AS times, count(DISTINCT doc_id) AS docs FROM (SELECT source, doc_id, {_KEY} AS key FROM ({_LINES}))
WHERE length(key) BETWEEN 1 AND 80 GROUP BY source, key HAVING count(*) >= 3""",
)
def repeated_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = blocks.repeated_edges(_lines(spark, sf), ["source"]).where("is_repeated")
    return rows.groupBy("source", "key").agg(F.count("*").alias("times"), F.count_distinct("doc_id").alias("docs"))


def _level(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, 0).when(n <= 12, 1).when(n <= 24, 2).when(n <= 40, 3).otherwise(0)


@_register(
    "forward_fill_sections",
    f"""WITH b AS (SELECT doc_id, ord, {_CLEAN.format('text')} AS t, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 12 THEN 1 WHEN length(text) <= 24 THEN 2 WHEN length(text) <= 40 THEN 3 ELSE 0 END AS lv FROM ({_LINES})),
g AS (SELECT *, count(*) FILTER (lv = 1) OVER (PARTITION BY doc_id ORDER BY ord) AS g1 FROM b),
h AS (SELECT *, last_value(CASE WHEN lv = 1 THEN t END IGNORE NULLS) OVER w AS s1, last_value(CASE WHEN lv = 2 THEN t END IGNORE NULLS) OVER w AS s2, count(*) FILTER (lv = 2) OVER w AS g2 FROM g WINDOW w AS (PARTITION BY doc_id, g1 ORDER BY ord)),
i AS (SELECT *, last_value(CASE WHEN lv = 3 THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id, g1, g2 ORDER BY ord) AS s3 FROM h)
SELECT doc_id, CAST(ord AS BIGINT) AS ord, coalesce(s1, '正文') AS section, concat_ws(' / ', nullif(s2, ''), nullif(s3, '')) AS subsection FROM i""",
)
def forward_fill_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).withColumn("type", F.lit("title"))
    return blocks.assign_sections(rows, _level(F.col("text"))).select("doc_id", F.col("ord").cast("long").alias("ord"), "section", "subsection")


@_register(
    "noise_reasons",
    rf"""WITH b AS (SELECT {_CLEAN.format('text')} AS t FROM ({_LINES}))
SELECT coalesce(CASE WHEN t = '' THEN 'empty'
  WHEN regexp_full_match(t, '[\d\s.．·…-]{{1,16}}') OR contains(t, '目录') OR (len(regexp_extract_all(t, '\d+')) >= 6 AND regexp_matches(t, '[.．·…]{{2,}}')) THEN 'table_of_contents'
  WHEN length(t) <= 160 AND regexp_matches(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') THEN 'contact'
  WHEN regexp_matches(t, '^(资料来源|数据来源|来源)') AND length(t) <= 48 THEN 'source_only' END, 'kept') AS reason, count(*) AS n FROM b GROUP BY 1""",
)
def noise_reasons(spark: SparkSession, sf: str) -> DataFrame:
    reason = blocks.noise_reason(F.col("text"), F.lit("text"))
    return _lines(spark, sf).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@_register("html_strip", r"SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages")
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    t = T.strip_tags("html")
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


def _part_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A table per brand in HTML: its parts with name, size and price."""
    cell = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x.cast("string"), F.lit(f"</{tag}>"))
    row = F.concat(F.lit("<tr>"), cell("td", F.col("p_name")), cell("td", F.col("p_size")), cell("td", F.lit("n/a")), F.lit("</tr>"))
    parts = read(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("rows"))
    head = F.concat(F.lit("<table><caption>Parts of "), F.col("p_brand"), F.lit("</caption><tr><th>name</th><th>size</th><th></th></tr>"))
    return parts.select("p_brand", F.concat(head, F.array_join(F.transform("rows", lambda r: r["r"]), "\n"), F.lit("</table>")).alias("html"))


@_register(
    "html_table_parse",
    "SELECT p_brand, 'Parts of ' || p_brand AS caption, CAST(1 AS BIGINT) AS n_headers, count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns, arg_min(p_name, p_partkey) AS first_cell FROM part GROUP BY p_brand",
)
def html_table_parse(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    rows = _part_tables(spark, sf).select("p_brand", tables.parse(F.col("html")).alias("t"))
    return rows.select(
        "p_brand", t["caption"].alias("caption"), F.size(t["headers"]).cast("long").alias("n_headers"), F.size(t["rows"]).cast("long").alias("n_rows"),
        tables.column_count(t).cast("long").alias("n_columns"), F.get(F.get(t["rows"], 0), 0).alias("first_cell"),
    )


@_register(
    "table_summary",
    "SELECT p_brand, string_agg(p_name || ': size=' || p_size, '；' ORDER BY p_partkey) AS summary FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 3) GROUP BY p_brand",
)
def table_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _part_tables(spark, sf).select("p_brand", tables.parse(F.col("html")).alias("t"))
    return rows.select("p_brand", tables.summary(F.col("t")).alias("summary"))


def _chunks(spark: SparkSession, sf: str, sizes: tuple[int, ...], overlap: int) -> DataFrame:
    rows = _lines(spark, sf).withColumn("type", F.lit("text"))
    units = rows.select("doc_id", F.lit("").alias("section"), F.lit("").alias("subsection"), "ord", F.lit(1).alias("page"), "block_id", T.clean_text("text").alias("text"))
    return chunking.chunk_grid(units, sizes, overlap)


def _ends(text: str) -> str:
    return rf"list_filter(string_split(regexp_replace({text}, '([。！？!?；;])', '\1' || chr(1), 'g'), chr(1)), lambda x: {_CLEAN.format('x')} <> '')"


_RUNNING = "list_prepend(0, list_transform(range(1, len({0}) + 1), lambda i: CAST(list_sum(({0})[:i]) AS BIGINT)))"
#: From the list of running sums e, a start and room: the end of the run that fits, one element at least.
_CUT = "greatest({start} + 1, len(list_filter(e, lambda x: x <= e[{start}] + {room})))"


def _tail_sql(text: str, overlap: int) -> str:
    """The whole sentences at the end of ``text`` that fit ``overlap`` tokens, one at least, among the last of its tokens."""
    window = chunking.TAIL_WINDOW * overlap
    parts = rf"string_split(regexp_replace({text}, '({_COUNTED})', chr(2) || '\1', 'g'), chr(2))"
    last = f"array_to_string(list_slice({parts}, greatest(2, len({parts}) - {window - 1}), -1), '')"
    sentences = f"list_transform({_ends(_CLEAN.format(last))}, lambda s: {_CLEAN.format('s')})"
    fitting = f"len(list_filter(range(1, len(ss) + 1), lambda i: list_sum(list_transform(ss[len(ss) - i + 1:], lambda s: {_COUNT.format('s')})) <= {overlap}))"
    return f"(SELECT coalesce(array_to_string(ss[len(ss) - greatest(1, {fitting}) + 1:], ''), '') FROM (SELECT {sentences} AS ss))"


def _pack_sql(sizes: tuple[int, ...], overlap: int) -> str:
    """The packing of lines as recursion: "pieces" cuts long lines, "packed" (size, doc_id, chunk_no, text, blocks) walks from cut to cut."""
    return f"""WITH RECURSIVE sizes AS (SELECT unnest({list(sizes)}) AS size),
lines AS (SELECT size, doc_id, ord, t, {_ends('t')} AS s FROM (SELECT doc_id, ord, {_CLEAN.format('text')} AS t FROM ({_LINES})), sizes WHERE t <> ''),
long AS (SELECT size, doc_id, ord, list_transform(s, lambda x: {_CLEAN.format('x')}) AS s, {_RUNNING.format('n')} AS e
  FROM (SELECT *, list_transform(s, lambda x: {_COUNT.format('x')}) AS n FROM lines) WHERE {_COUNT.format('t')} > size),
pieces AS (SELECT size, doc_id, ord, 1 AS a, {_CUT.format(start='1', room='size')} AS b FROM long WHERE len(s) > 0
  UNION ALL SELECT p.size, p.doc_id, p.ord, p.b, {_CUT.format(start='p.b', room='p.size')} FROM pieces p JOIN long l ON l.size = p.size AND l.doc_id = p.doc_id AND l.ord = p.ord WHERE p.b <= len(l.s)),
cut AS (SELECT l.size, l.doc_id, l.ord, a, e[b] - e[a] AS n, array_to_string(s[a : b - 1], '') AS t FROM pieces p JOIN long l ON l.size = p.size AND l.doc_id = p.doc_id AND l.ord = p.ord),
units AS (
  SELECT size, doc_id, ord, 0 AS a, 0 AS i, t FROM lines WHERE {_COUNT.format('t')} <= size
  UNION ALL SELECT size, doc_id, ord, a, 0, t FROM cut WHERE n <= size
  UNION ALL SELECT size, doc_id, ord, a, i, array_to_string(regexp_extract_all(t, '{_COUNTED}')[i + 1 : i + size], '')
    FROM (SELECT *, unnest(range(0, n, size)) AS i FROM cut WHERE n > size)
), docs AS (SELECT size, doc_id, u, {_RUNNING.format('n')} AS e FROM (SELECT size, doc_id, list(t ORDER BY ord, a, i) AS u, list({_COUNT.format('t')} ORDER BY ord, a, i) AS n FROM units GROUP BY size, doc_id)),
steps AS (
  SELECT size, doc_id, 0 AS chunk_no, 1 AS a, {_CUT.format(start='1', room='size')} AS b, array_to_string(u[1 : {_CUT.format(start='1', room='size')} - 1], chr(10) || chr(10)) AS text FROM docs
  UNION ALL
  SELECT size, doc_id, chunk_no + 1, a, b, trim(CASE WHEN tail = '' THEN '' ELSE tail || chr(10) || chr(10) END || array_to_string(u[a : b - 1], chr(10) || chr(10)), ' ' || chr(9) || chr(10) || chr(13))
  FROM (SELECT *, {_CUT.format(start='a', room=f"(size - {_COUNT.format('tail')})")} AS b
    FROM (SELECT d.size, d.doc_id, chunk_no, s.b AS a, u, e, {_tail_sql('s.text', overlap)} AS tail FROM steps s JOIN docs d ON d.size = s.size AND d.doc_id = s.doc_id WHERE s.b <= len(d.u)))
), packed AS (SELECT size, doc_id, chunk_no, text, b - a AS blocks, {_COUNT.format('text')} AS tokens FROM steps)
"""


@_register("chunk_pack", f"{_pack_sql((256,), 50)}SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, tokens, CAST(blocks AS INTEGER) AS blocks, md5(text) AS digest FROM packed")
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, (256,), 50).select("doc_id", "chunk_no", "tokens", F.size("block_ids").alias("blocks"), F.md5("text").alias("digest"))


@_register(
    "chunk_grid_stats",
    f"""{_pack_sql((256, 512, 1024), 50)}SELECT CAST(size AS INTEGER) AS size, CAST(sum(tokens) AS BIGINT) AS sum_tokens, count(*) FILTER (tokens < 64) AS below_64, count(*) FILTER (tokens >= 512) AS from_512,
  count(*) FILTER (tokens >= 1024) AS from_1024, count(*) AS chunks, round(avg(length(text)), 4) AS avg_chars, round(avg(tokens), 4) AS avg_tokens, min(tokens) AS min_tokens, max(tokens) AS max_tokens FROM packed GROUP BY size""",
)
def chunk_grid_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_stats(_chunks(spark, sf, (256, 512, 1024), 50), ["size"])


@_register(
    "evidence_items",
    f"""WITH {_bm25_sql('', _BODY, _ASKED)} SELECT query_id, CAST(rank AS BIGINT) AS rank, 'E' || rank AS evidence_id, id, regexp_replace(substr(d.text, 1, 900), '^\\s+|\\s+$', '', 'g') AS text
FROM top JOIN documents d ON d.doc_id = top.id WHERE rank <= {K}""",
)
def evidence_items(spark: SparkSession, sf: str) -> DataFrame:
    hits = _body_hits(spark, sf).join(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return evidence.evidence_items(hits).select("query_id", "rank", "evidence_id", "id", "text")


@_register(
    "refusal_gate",
    f"""WITH {_bm25_sql('', _BODY, _ASKED)}, best AS (SELECT query_id, bool_and(score < 100) AS weak FROM top WHERE rank <= {K} GROUP BY 1)
SELECT item_id AS query_id, coalesce(weak, true) AS should_refuse FROM benchmark LEFT JOIN best ON best.query_id = item_id""",
)
def refusal_gate(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.refusals(read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")), _body_hits(spark, sf), "score", 100)


_WORDS_SQL = "list_filter(list_distinct({0}), lambda t: length(t) > 1 AND t NOT IN ({1}))"


def _words_sql(column: str) -> str:
    return _WORDS_SQL.format(_TOKENS.format(column), ", ".join(f"'{w}'" for w in evidence.STOPWORDS))


_NORM = r"lower(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"


@_register(
    "claim_support",
    rf"""WITH {_bm25_sql('', _BODY, _ASKED)}, c AS (SELECT query_id, rank, id, b.text AS claim, d.text AS cited FROM top JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = top.id WHERE rank <= 3),
w AS (SELECT *, {_words_sql('claim')} AS asked, {_words_sql('cited')} AS there, regexp_extract_all(claim, '\d+(?:\.\d+)?%?') AS numbers,
  list_filter(regexp_split_to_array(claim, '[，。；、,:：\s]+'), lambda p: length(p) >= 4) AS phrases FROM c),
s AS (SELECT *, len(list_intersect(asked, there)) AS shared FROM w)
SELECT query_id, CAST(rank AS BIGINT) AS rank, id, {_NORM.format('claim')} <> '' AND {_NORM.format('cited')} <> '' AND len(list_filter(numbers, lambda n: NOT contains(cited, n))) = 0
  AND CASE WHEN len(asked) = 0 THEN contains({_NORM.format('cited')}, {_NORM.format('claim')})
    ELSE shared >= 0.4 * len(asked) OR shared >= 3 OR (shared >= 2 AND len(list_filter(phrases, lambda p: contains({_NORM.format('cited')}, {_NORM.format('p')}))) > 0) END AS supported FROM s""",
)
def claim_support(spark: SparkSession, sf: str) -> DataFrame:
    rows = _body_hits(spark, sf, 3).join(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("cited")), "id")
    rows = rows.join(F.broadcast(read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("claim"))), "query_id")
    return rows.select("query_id", "rank", "id", evidence.claim_supported(F.col("claim"), F.col("cited")).alias("supported"))


@_register(
    "history_last_n",
    "SELECT conv_id, turn, coalesce(string_agg(role || ': ' || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations",
)
def history_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.history(read(spark, sf, "conversations"), 6)


CHAT, DOMAIN, GENERAL = ("you", "who are"), ("price", "order", "the"), ("what is", "que", "der")


def _holds(words: tuple[str, ...], text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@_register(
    "route_queries",
    rf"""SELECT conv_id, turn, CASE WHEN {_holds(CHAT, 'text')} THEN 'DIRECT' WHEN d AND NOT g THEN 'RETRIEVE' WHEN g AND NOT d THEN 'DIRECT' END AS decision
FROM (SELECT *, {_holds(DOMAIN, 'lower(text)')} OR regexp_matches(text, '\d{{6}}\.(?:SH|SZ)|\d{{6}}|[A-Za-z]{{1,5}}\.[A-Z]+') AS d, {_holds(GENERAL, 'lower(text)')} AS g FROM conversations WHERE role = 'user')""",
)
def route_queries(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", evidence.route(F.col("text"), CHAT, DOMAIN, GENERAL).alias("decision"))


_ASKED_OF_NATIONS = """asked AS (SELECT n_nationkey AS query_id, n_name AS a, lead(n_name) OVER (ORDER BY n_nationkey) AS b, lead(n_name, 2) OVER (ORDER BY n_nationkey) AS c FROM nation)"""


@_register(
    "decompose_plan",
    f"""WITH {_ASKED_OF_NATIONS}
SELECT query_id, 0 AS branch, a || ' 毛利率 margin' AS query FROM asked WHERE query_id % 3 = 0 AND b IS NOT NULL UNION ALL SELECT query_id, 1, b || ' 毛利率 margin' FROM asked WHERE query_id % 3 = 0 AND b IS NOT NULL
UNION ALL SELECT query_id, 0, a || ' 经营情况' FROM asked WHERE query_id % 3 = 1 AND c IS NOT NULL UNION ALL SELECT query_id, 1, b || ' 经营情况' FROM asked WHERE query_id % 3 = 1 AND c IS NOT NULL
UNION ALL SELECT query_id, 2, c || ' 经营情况' FROM asked WHERE query_id % 3 = 1 AND c IS NOT NULL UNION ALL SELECT query_id, 0, '关于' || a || '的收入' FROM asked WHERE query_id % 3 = 2""",
)
def decompose_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation is asked about: compared with the next, summed up with the next two, or by itself."""
    nation = read(spark, sf, "nation")
    w = Window.orderBy("n_nationkey")  # a row per nation
    rows = nation.select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("a"), F.lead("n_name").over(w).alias("b"), F.lead("n_name", 2).over(w).alias("c"))
    kind = F.col("query_id") % 3
    query = (
        F.when((kind == 0) & F.col("b").isNotNull(), F.concat("a", F.lit("和"), "b", F.lit("相比，的毛利率 margin 谁更高？")))
        .when((kind == 1) & F.col("c").isNotNull(), F.concat(F.lit("总结一下"), "a", F.lit("、"), "b", F.lit("与"), "c", F.lit("经营情况。")))
        .when(kind == 2, F.concat(F.lit("关于"), "a", F.lit("的收入")))
    )
    asked = rows.select("query_id", query.alias("query")).where("query IS NOT NULL")
    return decompose.branches(decompose.plan(asked, nation.select(F.col("n_name").alias("name"))))


@_register("first_title_per_source", "SELECT source, arg_min(title, doc_id) AS title, count(*) AS docs FROM (SELECT source, doc_id, nullif(regexp_replace(string_split(text, chr(10))[1], '^\\s+|\\s+$', '', 'g'), '') AS title FROM documents) GROUP BY source")
def first_title_per_source(spark: SparkSession, sf: str) -> DataFrame:
    title = F.nullif(T.strip(F.get(F.split("text", "\n"), 0)), F.lit(""))
    return read(spark, sf, "documents").select("source", "doc_id", title.alias("t")).groupBy("source").agg(F.min_by("t", F.when(F.col("t").isNotNull(), F.col("doc_id"))).alias("title"), F.count("*").alias("docs"))


@_register("index_ids", "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS vector_id FROM documents WHERE lang <> 'es' AND length(text) > 0")
def index_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Dense ids in document order of what is indexed; ranges are numbered apart and then offset, so that no task sorts all rows."""
    rows = read(spark, sf, "documents").where("lang != 'es' AND length(text) > 0").select("doc_id").repartitionByRange("doc_id")
    # written once: both uses must see the same ranges
    rows = materialize(rows.withColumn("part", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + within).cast("long").alias("vector_id"))


@_register("resume_todo", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_todo(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@_register("type_counters", "SELECT lang, source, count(*) AS n, count(DISTINCT doc_id) AS docs FROM documents GROUP BY lang, source")
def type_counters(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@_register(
    "judge_means",
    """SELECT coalesce(event_type, 'average') AS event_type, count(*) AS n, round(avg(value) FILTER (event_id % 5 <> 0), 4) AS value, count(value) FILTER (event_id % 5 <> 0) AS n_value FROM events GROUP BY ROLLUP (event_type)""",
)
def judge_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means over what is there: every fifth value is NaN, as a judge that failed leaves it."""
    rows = read(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return evaluation.rollup_means(rows, "event_type", ["value"], digits=4)


@_register("embedding_text", "SELECT doc_id, md5(concat_ws(chr(10), '标题：' || nullif(source, ''), '公司：' || nullif(lang, ''), nullif(text, ''))) AS digest FROM documents")
def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return read(spark, sf, "documents").select("doc_id", F.md5(lexical.embedding_text(F.col("source"), F.col("lang"), none, none, F.col("text"))).alias("digest"))
