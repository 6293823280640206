"""Registered queries on blocks, index records, reports and ideographs, and the SQL each must equal.

The tables hold no parsed reports, so blocks, file names and chunks are derived from
whole tables by rules that both sides state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.functions import text as T
from quillspark.operators import answers, cascade, decompose, evaluation, evidence, index, layout, lexical
from quillspark.plans.cleaning import _CLEAN
from quillspark.plans.retrieval import _ASKED, _BODY, K, _bm25_sql, _body_hits, _register, gold
from quillspark.session import numbered, read

# Lines of documents as blocks: markers in place of some lines, a page of 24 lines in two columns.
_MARKED = """CASE WHEN ord % 31 = 4 THEN '相关研究报告' WHEN ord % 47 = 9 THEN '免责声明' WHEN ord % 13 = 7 THEN '风险提示：' || text WHEN ord % 17 = 3 THEN '资料来源：' || source WHEN ord % 29 = 6 THEN '研究所'
  WHEN ord % 53 = 2 THEN '内容目录' WHEN ord % 53 = 25 THEN '1 .... 2 3 .... 4 5 .... 6' WHEN ord % 24 = 0 THEN source || ' ' || ord ELSE text END"""
_KIND = "CASE WHEN ord % 31 = 4 OR ord % 47 = 9 OR ord % 53 = 2 OR ord % 11 = 5 THEN 'title' WHEN ord % 19 = 8 THEN 'figure' WHEN ord % 23 = 11 THEN 'table' ELSE 'text' END"
_BLOCKS = "ord, {page} + 1 AS page, CASE WHEN ord % 2 = 0 THEN 40.0 ELSE 340.0 END AS x0, CASE WHEN ord % 7 = 0 THEN 560.0 WHEN ord % 2 = 0 THEN 280.0 ELSE 560.0 END AS x1, 20.0 + 34.0 * (ord % 24) AS top, 40.0 + 34.0 * (ord % 24) AS bottom"


def _blocks(spark: SparkSession, sf: str, marked: str = _MARKED) -> DataFrame:
    lines = read(spark, sf, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    box = [f"CAST({x.split(' AS ')[0]} AS DOUBLE) AS {x.split(' AS ')[1]}" for x in _BLOCKS.split(", ")[2:]]
    rows = lines.selectExpr("doc_id", "ord", "CAST(floor(ord / 24) AS INT) + 1 AS page", *box, f"{_KIND} AS type", f"{marked} AS text")
    return rows.withColumn("text", T.clean_text("text")).withColumn("block_id", F.concat(F.lit("b"), F.col("ord").cast("string")))


def _any(pattern: str, text: str = "t") -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _cascade_sql(marked: str = _MARKED) -> str:
    return f"""lines AS (SELECT doc_id, source, lang, unnest(range(len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS text FROM documents),
raw AS (SELECT doc_id, {_BLOCKS.format(page="ord // 24")}, {_KIND} AS type, {marked} AS text FROM lines),
b AS (SELECT *, {_CLEAN.format("text")} AS t FROM raw),
p AS (SELECT doc_id, page, bool_or(type = 'title' AND (contains(t, '内容目录') OR contains(t, '图表目录') OR t = '目录')) AS seed, bool_or(type = 'title') AS titled, bool_or(type = 'text') AS worded,
  coalesce(bool_and(lst) FILTER (type = 'text'), true) AS listed FROM (SELECT *, {{contents}} AS lst FROM b) GROUP BY doc_id, page),
q AS (SELECT *, max(page) FILTER (seed) OVER (PARTITION BY doc_id) AS last_seed FROM p),
r AS (SELECT *, min(page) FILTER (page > last_seed AND (titled OR NOT listed)) OVER (PARTITION BY doc_id) AS stop FROM q),
toc AS (SELECT doc_id, page FROM r WHERE seed OR (page > last_seed AND worded AND (stop IS NULL OR page < stop))),
e AS (SELECT doc_id, ord, regexp_replace(t, '\\d+', '#', 'g') AS k FROM b WHERE (top <= 0.08 * 842 OR bottom >= 0.92 * 842)),
rep AS (SELECT doc_id, ord FROM e WHERE length(k) BETWEEN 1 AND 80 QUALIFY count(*) OVER (PARTITION BY doc_id, k) >= 3),
f AS (SELECT b.*, toc.page IS NOT NULL AS in_toc, rep.ord IS NOT NULL AS edge, {{contact}} AS contact, {{noise}} AS noise, {{contents}} AS listed, {_any(cascade.RELATED_REPORT)} AS rel, {_any(cascade.RISK)} AS risk,
  regexp_replace(t, '^[：:;；]+|[：:;；]+$', '', 'g') IN ({", ".join(f"'{x}'" for x in cascade.TERMINAL_TITLES)}) AS term, {{noisy}} AS noisy, {_any(cascade.SKIP_SECTION)} AS skip, {{source}} AS src, {{figure}} AS fig,
  b.page = 1 AND ((top <= 0.20 * 842 AND (type = 'title' OR length(t) <= 120)) OR (x0 >= 0.60 * 595 AND bottom <= 0.38 * 842 AND (type = 'title' OR {_any(cascade.RATING)} OR {_any(cascade.ANALYST)}))) AS cover
  FROM b LEFT JOIN toc ON toc.doc_id = b.doc_id AND toc.page = b.page LEFT JOIN rep ON rep.doc_id = b.doc_id AND rep.ord = b.ord),
g AS (SELECT *, t <> '' AND NOT in_toc AND NOT edge AS plain FROM f),
h AS (SELECT *, plain AND type = 'title' AND rel AS m_rel, plain AND type = 'title' AND term AND NOT rel AS m_term, type = 'text' AND risk AND NOT in_toc AS m_risk, type = 'title' AND NOT rel AND NOT term AND NOT skip AS m_title FROM g),
i AS (SELECT *, max(CASE WHEN m_rel OR m_term OR m_risk THEN ord END) OVER w AS a, max(CASE WHEN m_title THEN ord END) OVER w AS n FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT i.*, x.m_term AS a_term, x.m_rel AS a_rel, x.page AS a_page, x.page = i.page AND i.top >= x.bottom AND ((i.x0 >= 0.55 * 595 AND x.x0 >= 0.55 * 595) OR
  greatest(least(i.x1, x.x1) - greatest(i.x0, x.x0), 0) / greatest(least(i.x1 - i.x0, x.x1 - x.x0), 1) >= 0.2) AS follows FROM i LEFT JOIN h x ON x.doc_id = i.doc_id AND x.ord = i.a)
SELECT doc_id, ord, CASE WHEN cover AND contact THEN 'analyst_info' WHEN m_risk THEN NULL WHEN t = '' THEN 'empty' WHEN in_toc THEN 'table_of_contents_page' WHEN edge THEN 'header_or_footer'
  WHEN type = 'text' AND contact THEN 'analyst_info' WHEN type = 'text' AND noise THEN 'text_noise' WHEN m_rel THEN 'related_report_title' WHEN m_term THEN 'terminal_section_title' WHEN type = 'title' AND noisy THEN 'title_noise'
  WHEN a_rel AND (n IS NULL OR n < a) AND follows AND type IN ('title', 'text') AND NOT risk THEN 'related_report_block' WHEN a_term AND a_page <= page THEN 'terminal_section_block' WHEN src THEN 'source_only'
  WHEN type = 'text' AND listed THEN 'table_of_contents_noise' WHEN type = 'figure' AND NOT fig THEN 'low_quality_figure_ocr' END AS reason FROM j"""


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


_NOISY_COVER = (
    "(length(t) >= 8 AND ((len(regexp_extract_all(t, '[A-Za-z0-9]{2,}')) > 0 AND list_sum(list_transform(regexp_extract_all(t, '[A-Za-z0-9]{2,}'), lambda x: length(x))) / length(t) > 0.55 AND "
    + _n("[一-鿿]") + " <= 6) OR (" + _n("[A-Za-z]{2,}") + " >= 4 AND " + _n("[一-鿿]") + " <= 4)))"
)
_RULES = {
    "contact": f"(t <> '' AND length(t) <= 160 AND {_any(cascade.CONTACT)} AND ({_any(cascade.CONTACT_SURE)} OR ({_any(cascade.CONTACT_PHONE)} AND {_any(cascade.PHONE_NUMBER)}) OR ({_any('^(分析师|联系人)')} AND length(t) <= 64)))",
    "noise": f"(t = '' OR (length(t) <= 20 AND t IN ({', '.join(repr(x) for x in cascade.NOISE_TEXTS)})) OR (length(t) <= 40 AND {_any(cascade.NOISE_END)}))",
    "contents": "(t <> '' AND (contains(t, '目录') OR regexp_full_match(t, '[\\d\\s.．·…-]{1,16}') OR (" + _n("\\d+") + " >= 6 AND " + _any("[.．·…]{2,}") + ") OR (" + _n("[一二三四五六七八九十]、") + " >= 3 AND " + _n("\\d{1,2}") + " >= 3)"
    " OR (" + _n("[（(][一二三四五六七八九十\\d]+[）)]") + " >= 3 AND " + _n("\\d{1,2}") + " >= 4) OR (" + _n("[一二三四五六七八九十]+、|[（(][一二三四五六七八九十\\d]+[）)]") + " >= 4 AND " + _n("\\d{1,2}") + " >= 3)))",
    "noisy": f"({_any(cascade.SKIP_SECTION)} OR t IN ({', '.join(repr(x) for x in cascade.NOISY_TITLES)}) OR {_any(cascade.NOISY_TITLE)} OR ({_NOISY_COVER} AND {_n('[一-鿿]')} <= 6) OR length(t) <= 2)",
    "source": f"({_any(cascade.SOURCE_LINE)})",  # a block is one line here, which names its source; those beyond 48 characters too
    "figure": f"({_any(cascade.FIGURE_WORDS)} AND NOT {_any(cascade.SOURCE_LINE)} AND length(t) >= 18)",
}


def _ruled(sql: str) -> str:
    """SQL with the rules in place of their names in braces."""
    for name, rule in _RULES.items():
        sql = sql.replace(f"{{{name}}}", rule)
    return sql.replace("{{", "{").replace("}}", "}")


@_register("block_cascade", _ruled("WITH " + _cascade_sql()))
def block_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Why each line is dropped as a block of a report, null for those that stay."""
    rows = _blocks(spark, sf)
    pages = rows.select("doc_id", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height")).distinct()
    return cascade.classified_blocks(rows, pages).select("doc_id", F.col("ord").cast("long").alias("ord"), "reason")


# A document as the four chunks of a report: cover, text, table, and the table's summary, which misses its table in a third of them.
_HEAD_SQL = "coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')[1], '')"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    none = F.lit(None).cast("string")
    own = F.when(F.col("doc_id") % 3 == 0, "t2").otherwise("t1")
    part = lambda n, kind, text, table, caption: F.struct(F.lit(n).alias("ord"), F.lit(kind).alias("chunk_type"), text.alias("text"), table.alias("table_id"), caption.alias("caption"))
    cover = F.concat(F.lit("标题："), T.first_nonempty_line("text"), F.lit("\n公司："), "source")
    note = F.concat(F.lit("表名：T"), F.col("doc_id").cast("string"), F.lit("\n所属章节：正文\n前后文："), "source")
    parts = F.array(
        part(0, index.COVER, cover, none, none), part(1, "text_chunk", F.col("text"), none, none),
        part(2, index.RAW_TABLE, F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("<table>"), F.col("doc_id").cast("string"), F.lit("</table>"))).otherwise(" "), F.lit("t1"), F.col("lang")),
        part(3, index.TABLE_SUMMARY, note, own, none),
    )
    rows = docs.select("doc_id", F.inline(parts))
    return rows.withColumn("chunk_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("ord").cast("string")))


_CHUNKS_SQL = f"""chunks AS (SELECT doc_id, 0 AS ord, 'cover_summary_chunk' AS chunk_type, '标题：' || {_HEAD_SQL} || chr(10) || '公司：' || source AS text, NULL AS table_id, NULL AS caption FROM documents
  UNION ALL SELECT doc_id, 1, 'text_chunk', text, NULL, NULL FROM documents
  UNION ALL SELECT doc_id, 2, 'raw_table_chunk', CASE WHEN doc_id % 10 <> 0 THEN '<table>' || doc_id || '</table>' ELSE ' ' END, 't1', lang FROM documents
  UNION ALL SELECT doc_id, 3, 'table_summary_chunk', '表名：T' || doc_id || chr(10) || '所属章节：正文' || chr(10) || '前后文：' || source, CASE WHEN doc_id % 3 = 0 THEN 't2' ELSE 't1' END, NULL FROM documents)"""


@_register(
    "index_records",
    f"""WITH {_CHUNKS_SQL}, d AS (SELECT doc_id, coalesce(nullif({_HEAD_SQL}, ''), CAST(doc_id AS VARCHAR)) AS title, source, lang FROM documents)
SELECT c.doc_id, ord, chunk_type IN ('text_chunk', 'raw_table_chunk') AND regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') <> '' AS indexed,
  CASE WHEN chunk_type NOT IN ('text_chunk', 'raw_table_chunk') THEN 'excluded_chunk_type:' || chunk_type WHEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') = '' THEN 'empty_text' END AS skip_reason,
  md5(concat_ws(chr(10), '标题：' || title, '公司：' || source, CASE WHEN chunk_type = 'raw_table_chunk' AND c.doc_id % 3 <> 0 THEN '前后文：' || source END,
    CASE WHEN chunk_type = 'raw_table_chunk' THEN '表名：' || CASE WHEN c.doc_id % 3 <> 0 THEN 'T' || c.doc_id ELSE lang END END, nullif(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), ''))) AS digest
FROM chunks c JOIN d ON d.doc_id = c.doc_id""",
)
def index_records(spark: SparkSession, sf: str) -> DataFrame:
    """What every chunk is embedded as, and whether it is indexed."""
    return index.docstore_records(_chunks(spark, sf)).select("doc_id", "ord", "indexed", "skip_reason", F.md5("embedding_text").alias("digest"))


@_register(
    "load_summary",
    f"""WITH {_CHUNKS_SQL}, r AS (SELECT *, CASE WHEN chunk_type NOT IN ('text_chunk', 'raw_table_chunk') THEN 'excluded_chunk_type:' || chunk_type WHEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') = '' THEN 'empty_text' END AS why FROM chunks)
SELECT 'all' AS kind, chunk_type AS name, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'indexed', chunk_type, count(*) FROM r WHERE why IS NULL GROUP BY 2 UNION ALL SELECT 'skipped', why, count(*) FROM r WHERE why IS NOT NULL GROUP BY 2
UNION ALL SELECT 'tables', 'summaries', count(*) FROM documents UNION ALL SELECT 'tables', 'matched', count(*) FROM documents WHERE doc_id % 3 <> 0""",
)
def load_summary(spark: SparkSession, sf: str) -> DataFrame:
    return index.load_summary(index.docstore_records(_chunks(spark, sf)))


@_register("linked_tables", f"WITH {_CHUNKS_SQL} SELECT c.doc_id, c.ord, CASE WHEN c.ord = 3 AND c.doc_id % 3 <> 0 THEN c.doc_id || '#2' END AS raw_chunk_id, md5(CASE WHEN c.ord = 3 AND c.doc_id % 3 <> 0 THEN r.text END) AS digest FROM chunks c JOIN chunks r ON r.doc_id = c.doc_id AND r.ord = 2")
def linked_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The raw table of every table summary."""
    rows = _chunks(spark, sf)
    return index.linked_tables(rows, rows).select("doc_id", "ord", "raw_chunk_id", F.md5("raw_text").alias("digest"))


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of reports, named by a rule."""
    n, names = F.col("doc_id"), F.array(*map(F.lit, NAMES))
    company = F.concat(F.get(names, (n % len(NAMES)).cast("int")), F.lpad((n * 7919 % 1000000).cast("string"), 6, "0"))
    return read(spark, sf, "documents").select(n, F.concat_ws("_", n.cast("string"), F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0")), company, F.lit("国金证券"), F.concat(F.lit("深度报告 "), "lang"), F.when(n % 2 == 0, "买入")).alias("name"))


NAMES = ("甲药业", "乙银行", "丙能源", "丁科技", "戊证券业", "己电子")
_NAME_SQL = "[" + ", ".join(f"'{x}'" for x in NAMES) + f"][doc_id % {len(NAMES)} + 1]"
_CODE_SQL = "lpad(CAST(doc_id * 7919 % 1000000 AS VARCHAR), 6, '0')"
_SUFFIX_SQL = "CASE " + " ".join(f"WHEN {_CODE_SQL}[1:3] IN ({', '.join(repr(x) for x in starts)}) THEN '{s}'" for s, starts in layout.STOCK_SUFFIXES) + " ELSE 'SH' END"


@_register(
    "file_fields",
    f"""WITH n AS (SELECT doc_id, lang, {_NAME_SQL} AS name, {_CODE_SQL} AS code, {_SUFFIX_SQL} AS suffix FROM documents)
SELECT doc_id, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS date, CASE WHEN contains(name, '证券') THEN '' ELSE name || '（' || code || '.' || suffix || '）' END AS company,
  CASE WHEN contains(name, '证券') THEN name || code ELSE '国金证券' END AS institution,
  CASE WHEN contains(name, '证券') THEN '国金证券深度报告 ' || lang || CASE WHEN doc_id % 2 = 0 THEN ' 买入' ELSE '' END ELSE '深度报告 ' || lang || CASE WHEN doc_id % 2 = 0 THEN ' 买入' ELSE '' END END AS title,
  CASE WHEN doc_id % 2 = 0 THEN '买入' ELSE '' END AS rating FROM n""",
)
def file_fields(spark: SparkSession, sf: str) -> DataFrame:
    """What the file names of reports tell."""
    return _reports(spark, sf).select("doc_id", layout.file_fields(F.concat("name", F.lit(".pdf"))).alias("f")).select("doc_id", "f.*")


@_register("entity_names", f"SELECT DISTINCT 'C' || source AS name FROM documents UNION SELECT DISTINCT {_NAME_SQL} FROM documents WHERE NOT contains({_NAME_SQL}, '证券') AND NOT contains({_NAME_SQL}, '电子') UNION SELECT '深度报告 ' || lang FROM documents UNION SELECT '买入' FROM documents WHERE doc_id % 2 = 0")
def entity_names(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary of names that queries are taken apart by."""
    docs = _reports(spark, sf).join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return decompose.names_of_documents(docs.select(F.col("name").alias("doc_id"), F.concat(F.lit("C"), "source").alias("company")))


# Names of parts as runs of ideographs, by a letter's place in the alphabet.
_LATIN, _HAN = "abcdefghijklmnopqrstuvwxyz ", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄宇"
_BIGRAMS = "list_transform(range(1, greatest(length(t), 2)), lambda i: t[i:i + 1])"


@_register(
    "bm25_ideographs",
    f"""WITH names AS (SELECT p_partkey AS id, translate(lower(p_name), '{_LATIN}', '{_HAN}') AS t FROM part), docs AS (SELECT id, {_BIGRAMS} AS tokens FROM names),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM docs) GROUP BY id, term), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(len(tokens)) / count(*) AS avgdl FROM docs),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT sum(raw) / count(*) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT DISTINCT dense_rank() OVER (ORDER BY t) AS query_id, t FROM names), unnest({_BIGRAMS}) u(term) GROUP BY query_id, term),
s AS (SELECT query_id, tf.id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl))), 4) AS score FROM q JOIN tf ON tf.term = q.term JOIN idf ON idf.term = q.term JOIN docs ON docs.id = tf.id, n GROUP BY query_id, tf.id HAVING sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl))) > 0)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS rank, id, score FROM s QUALIFY rank <= {K}""",
)
def bm25_ideographs(spark: SparkSession, sf: str) -> DataFrame:
    """Search among runs of ideographs, which are segmented: every distinct name is a query."""
    names = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.translate(F.lower("p_name"), _LATIN, _HAN).alias("t"))
    asked = numbered(names.select("t").distinct(), "t", "query_id")
    return lexical.best_of_texts(names, asked, K, T.bigrams)


_GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@_register(
    "matched_components",
    f"""WITH {_bm25_sql('', _BODY, _ASKED)}, {_GOLD} SELECT t.query_id, CAST(t.rank AS BIGINT) AS rank, t.id, CASE WHEN g.id IS NULL THEN '' ELSE (t.query_id % 2) || ':' || (t.id % 3) || ':p' || t.id || ',q' || t.id END AS matched
FROM top t LEFT JOIN gold g ON g.query_id = t.query_id AND g.id = t.id WHERE rank <= {K}""",
)
def matched_components(spark: SparkSession, sf: str) -> DataFrame:
    """Which components of the gold each hit holds; a document stands for two blocks, and a third that nobody asks for."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    hits = _body_hits(spark, sf).select("query_id", "rank", "id", F.col("id").alias("doc_id"), F.array(name("q", "id"), name("p", "id"), name("r", "id")).alias("block_ids"))
    known = gold(spark, sf).select("query_id", (F.col("query_id") % 2).alias("component"), (F.col("id") % 3).alias("group_id"), F.col("id").alias("doc_id"), F.explode(F.array(name("p", "id"), name("q", "id"))).alias("block_id"))
    shown = F.array_join(F.transform("matched", lambda m: F.concat_ws(":", m["component"].cast("string"), m["group_id"].cast("string"), F.array_join(m["block_ids"], ","))), ";")
    return evaluation.matched_components(hits, known).select("query_id", "rank", "id", shown.alias("matched"))


@_register(
    "route_comparison",
    """WITH m AS (SELECT event_type AS query_type, 'r' || user_id % 3 AS route, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2), l AS (SELECT query_type, route, 'value' AS metric, round(v, 6) AS x FROM m UNION ALL SELECT query_type, route, 'n', n FROM m),
w AS (SELECT query_type, metric, max(x) FILTER (route = 'r0') AS r0, max(x) FILTER (route = 'r1') AS r1, max(x) FILTER (route = 'r2') AS r2 FROM l GROUP BY 1, 2)
SELECT *, CASE WHEN greatest(r0, r1, r2) - r0 <= 1e-12 THEN 'r0' WHEN greatest(r0, r1, r2) - r1 <= 1e-12 THEN 'r1' ELSE 'r2' END AS best FROM w""",
)
def route_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Means of three routes side by side, and the best of each."""
    rows = read(spark, sf, "events").groupBy(F.col("event_type").alias("query_type"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("route"))
    return evaluation.comparison(rows.agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n")), ["r0", "r1", "r2"], ["value", "n"])


@_register(
    "question_types",
    "SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN 'summary' WHEN item_id % 5 = 1 THEN 'compare' WHEN item_id % 4 = 3 THEN 'summary' WHEN item_id % 4 = 2 THEN 'compare' ELSE 'fact' END AS query_type FROM benchmark",
)
def question_types(spark: SparkSession, sf: str) -> DataFrame:
    """The type of a question by its cues, else by how many components its gold has."""
    n = F.col("item_id")
    query = F.concat(F.col("text"), F.when(n % 5 == 0, "总结一下").when(n % 5 == 1, "谁更高").otherwise(""))
    return read(spark, sf, "benchmark").select(n.alias("query_id"), decompose.infer_type(query, n % 4).alias("query_type"))


def _said(query: Column, prompt: Column) -> Column:
    """A model's answer, by a rule: claims that cite the first two pieces of evidence and one that is not there."""
    claim = lambda text, *cited: F.concat(F.lit(f'{{"claim": "{text}", "citations": ['), F.lit(", ".join(f'"{c}"' for c in cited)), F.lit("]}"))
    good = F.concat(F.lit('Sure: {"answer": " '), F.length(query).cast("string"), F.lit(' ", "confidence": "high", "claims": ['), claim("one", "E2", "E1"), F.lit(", "), claim("  ", "E1"), F.lit(", "), claim("two", "E99"), F.lit("]}"))
    return F.when(F.length(query) % 3 != 0, good).otherwise("no JSON here")


@_register(
    "answers",
    f"""WITH {_bm25_sql('', _BODY, _ASKED)}, best AS (SELECT query_id, max(score) AS s FROM top WHERE rank <= {K} GROUP BY 1),
a AS (SELECT item_id AS query_id, coalesce(s < 100, true) AS refuse, length(text) % 3 <> 0 AS good, length(text) AS n FROM benchmark LEFT JOIN best ON best.query_id = item_id)
SELECT query_id, refuse AS should_refuse, CASE WHEN refuse THEN 'refused' WHEN good THEN 'model' ELSE 'extract' END AS source, CASE WHEN refuse THEN 'low' WHEN good THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN refuse THEN '{answers.REFUSAL}' WHEN good THEN CAST(n AS VARCHAR) END AS answer, CASE WHEN NOT refuse AND good THEN 'E1,E2' ELSE '' END AS used, CASE WHEN NOT refuse AND good THEN 2 ELSE 0 END AS claims FROM a""",
)
def answered(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with their claims checked against the evidence; extracts, whose text is another query's matter, are shown as null."""
    hits = _body_hits(spark, sf).join(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rows = answers.answered(asked, evidence.evidence_items(hits), evidence.refusals(asked, hits, "score", 100), _said)
    return rows.select("query_id", "should_refuse", "source", "confidence", F.when(F.col("source") != "extract", F.col("answer")).alias("answer"), F.array_join("used_evidence", ",").alias("used"), F.size("claims").alias("claims"))
