"""Registered queries that take reports from blocks to chunks of every kind, and the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import text as T
from quillspark.operators import cascade, regions, typed
from quillspark.plans import parsing
from quillspark.plans.cleaning import _CLEAN, _COUNT
from quillspark.plans.retrieval import _register
from quillspark.session import read

# Blocks as ``parsing`` makes them, with titles that number sections, tables in HTML and figures that name a trend.
_KIND = parsing._KIND
_TYPED = f"""CASE WHEN ord % 33 = 5 THEN '一、' || source || ' ' || ord WHEN ord % 33 = 16 THEN '（二）' || source WHEN ord % 33 = 27 THEN '3、' || ord WHEN ord % 47 = 9 OR ord % 53 = 2 THEN '四、' || lang
  WHEN ({_KIND}) = 'table' THEN '<table><caption>' || source || ' sales</caption><tr><th>k</th><th>n</th></tr><tr><td>r' || ord || '</td><td>' || length(text) || '</td></tr></table>'
  WHEN ({_KIND}) = 'figure' THEN '图' || ord || ' ' || source || ' 同比增长 ' || substr(text, 1, 40) WHEN ord % 37 = 1 THEN '评级：增持，' || text || '。' || source ELSE {parsing._MARKED} END"""
SIZE = 512


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    rows = parsing._blocks(spark, sf, _TYPED)
    pages = rows.select("doc_id", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height")).distinct()
    return cascade.classified_blocks(rows, pages)


def _sentences(text: str) -> str:
    return f"list_filter(string_split(regexp_replace({text}, '([{T.SENTENCE_END}])', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_CLEAN.format('x')} <> '')"


def _cuts(name: str, items: str) -> str:
    """Where greedy runs of items (g, k from 1, n) begin whose sums fit SIZE: {name}(g, k, after)."""
    return f"""{name}_c AS (SELECT g, k, n, sum(n) OVER (PARTITION BY g ORDER BY k) AS c, count(*) OVER (PARTITION BY g) AS last FROM {items}),
{name}_n AS (SELECT a.g, a.k, coalesce(min(b.k), any_value(a.last) + 1) AS after, any_value(a.last) AS last FROM {name}_c a LEFT JOIN {name}_c b ON b.g = a.g AND b.k > a.k AND b.c - a.c + a.n > {SIZE} GROUP BY a.g, a.k),
{name}_s(g, k) AS (SELECT g, k FROM {name}_n WHERE k = 1 UNION ALL SELECT s.g, n.after FROM {name}_s s JOIN {name}_n n ON n.g = s.g AND n.k = s.k WHERE n.after <= n.last),
{name} AS (SELECT g, k, after FROM {name}_s JOIN {name}_n USING (g, k))"""


_LEVEL = f"""CASE WHEN t = '' OR NOT (contains(t, '目录') OR (NOT regexp_matches(t, '[{T.SENTENCE_END}]') AND NOT (regexp_matches(t, '{T.CAPTION_TITLE}') AND length(t) > {T.CAPTION_CHARS}) AND
  (regexp_matches(t, '{T.NUMERAL_TITLE}') OR regexp_matches(t, '{T.BRACKET_TITLE}') OR regexp_matches(t, '{T.NUMBER_TITLE}') OR length(t) <= {T.TITLE_CHARS}))) THEN 0
  WHEN regexp_matches(t, '{T.NUMERAL_TITLE}') THEN 1 WHEN regexp_matches(t, '{T.BRACKET_TITLE}') THEN 2 WHEN regexp_matches(t, '^\\d+[、.]') THEN 3 WHEN regexp_matches(t, '{T.BARE_NUMBER_TITLE}') THEN 3
  WHEN length(t) <= {T.SHORT_TITLE} THEN 2 ELSE 1 END"""
_JUDGED = parsing._cascade_sql(_TYPED).replace("\nSELECT doc_id, ord, CASE WHEN cover AND contact", ",\njudged AS (SELECT doc_id, ord, page, type, x0, top, x1, bottom, t, cover, contact, risk, noisy, CASE WHEN cover AND contact") + ")"
_TYPED_SQL = f"""WITH RECURSIVE {_JUDGED}, kept AS (SELECT * FROM judged WHERE reason IS NULL),
lv AS (SELECT *, CASE WHEN type = 'title' THEN {_LEVEL} ELSE 0 END AS lv FROM kept WHERE NOT cover), s_a AS (SELECT *, count(*) FILTER (lv = 1) OVER (PARTITION BY doc_id ORDER BY ord) AS g1 FROM lv),
s_b AS (SELECT *, last_value(CASE WHEN lv = 1 THEN t END IGNORE NULLS) OVER w AS s1, last_value(CASE WHEN lv = 2 THEN t END IGNORE NULLS) OVER w AS s2, count(*) FILTER (lv = 2) OVER w AS g2 FROM s_a WINDOW w AS (PARTITION BY doc_id, g1 ORDER BY ord)),
s_c AS (SELECT *, last_value(CASE WHEN lv >= 3 THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id, g1, g2 ORDER BY ord) AS s3 FROM s_b),
sec AS (SELECT *, coalesce(s1, '正文') AS section, concat_ws(' / ', nullif(s2, ''), nullif(s3, '')) AS subsection FROM s_c),
tt AS (SELECT *, count(*) FILTER (type = 'text') OVER (PARTITION BY doc_id, section, subsection ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island FROM sec WHERE type IN ('text', 'title')),
tu AS (SELECT *, last_value(CASE WHEN type = 'title' THEN CASE WHEN noisy THEN '' ELSE t END END IGNORE NULLS) OVER (PARTITION BY doc_id, section, subsection, island ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS title FROM tt),
units AS (SELECT *, {_COUNT.format('u')} AS n FROM (SELECT doc_id, section, subsection, ord, page, CASE WHEN coalesce(title, '') <> '' THEN title || chr(10) || chr(10) || t ELSE t END AS u FROM tu WHERE type = 'text')),
sent AS (SELECT doc_id, ord, k, s, {_COUNT.format('s')} AS n FROM (SELECT doc_id, ord, unnest(range(1, len(x) + 1)) AS k, regexp_replace(unnest(x), '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, ord, {_sentences('u')} AS x FROM units WHERE n > {SIZE}))),
sent_g AS (SELECT *, count(*) FILTER (n > {SIZE}) OVER (PARTITION BY doc_id, ord ORDER BY k) AS wall FROM sent),
sent_i AS (SELECT {{{{'d': doc_id, 'o': ord, 'w': wall}}}} AS g, row_number() OVER (PARTITION BY doc_id, ord, wall ORDER BY k) AS k, n, s, k AS at FROM sent_g WHERE n <= {SIZE}),
{_cuts('run', 'sent_i')},
pieces AS (SELECT doc_id, ord, 0 AS a, 0 AS b, u AS p FROM units WHERE n <= {SIZE} UNION ALL SELECT any_value(i.g.d), any_value(i.g.o), min(i.at), 0, string_agg(i.s, '' ORDER BY i.k) FROM run r JOIN sent_i i ON i.g = r.g AND i.k >= r.k AND i.k < r.after GROUP BY r.g, r.k
  UNION ALL SELECT doc_id, ord, k, b, array_to_string(w[b * {SIZE} + 1 : (b + 1) * {SIZE}], '') FROM (SELECT doc_id, ord, k, w, unnest(range((len(w) + {SIZE} - 1) // {SIZE})) AS b FROM (SELECT doc_id, ord, k, {_COUNT.format('s')[4:-1]} AS w FROM sent WHERE n > {SIZE}))),
numbered AS (SELECT u.doc_id, u.section, u.subsection, u.page, u.ord, p.p, row_number() OVER (PARTITION BY u.doc_id, u.ord ORDER BY p.a, p.b) AS part, row_number() OVER (PARTITION BY u.doc_id, u.section, u.subsection ORDER BY u.ord, p.a, p.b) AS k FROM units u JOIN pieces p USING (doc_id, ord)),
items AS (SELECT {{{{'d': doc_id, 's': section, 'b': subsection}}}} AS g, k, {_COUNT.format('p')} AS n, p, page, 'b' || ord || CASE WHEN part > 1 THEN '#part' || part ELSE '' END AS id FROM numbered),
{_cuts('chunk', 'items')},
texts AS (SELECT c.g.d AS doc_id, c.g.s AS section, c.g.b AS subsection, c.k, string_agg(i.p, chr(10) || chr(10) ORDER BY i.k) AS text, string_agg(i.id, ',' ORDER BY i.k) AS ids, min(i.page) AS p0, max(i.page) AS p1 FROM chunk c JOIN items i ON i.g = c.g AND i.k >= c.k AND i.k < c.after GROUP BY c.g, c.k),
firsts AS (SELECT doc_id, section, subsection, min(ord) AS o FROM tt GROUP BY ALL),
anchors AS (SELECT doc_id, ord, page, top, bottom FROM sec WHERE type IN ('table', 'figure')),
near AS (SELECT * FROM (SELECT a.doc_id, a.ord, x.t, x.bottom <= a.top AS up, row_number() OVER (PARTITION BY a.doc_id, a.ord, x.bottom <= a.top ORDER BY CASE WHEN x.bottom <= a.top THEN -x.top ELSE x.top END) AS k
  FROM anchors a JOIN kept x ON x.doc_id = a.doc_id AND x.page = a.page AND x.type = 'text' AND (x.bottom <= a.top OR x.top >= a.bottom)) WHERE k <= 3),
said AS (SELECT doc_id, ord, up, k, unnest(range(len(x))) AS j, {_CLEAN.format('unnest(x)')} AS s FROM (SELECT *, {_sentences('t')} AS x FROM near)),
ranked AS (SELECT doc_id, ord, s, arg_min(up, o) AS up, min(o) AS o FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY NOT up, k, CASE WHEN up THEN -j ELSE j END) AS o FROM said) GROUP BY doc_id, ord, s),
context AS (SELECT doc_id, ord, string_agg(s, ' ' ORDER BY CASE WHEN up THEN -r ELSE r END) AS context FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY o) AS r FROM ranked) WHERE r <= 3 GROUP BY doc_id, ord),
tables_a AS (SELECT *, page = lag(page) OVER w + 1 AND section = lag(section) OVER w AND subsection = lag(subsection) OVER w AS more FROM sec WHERE type = 'table' WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
tables_b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, no ORDER BY ord) AS k FROM (SELECT *, count(*) FILTER (NOT coalesce(more, false)) OVER (PARTITION BY doc_id ORDER BY ord) AS no FROM tables_a)),
tables AS (SELECT doc_id, no, min(ord) AS ord, min(page) AS p0, max(page) AS p1, any_value(section) AS section, any_value(subsection) AS subsection, string_agg(t, chr(10) ORDER BY ord) AS html, string_agg('b' || ord, ',' ORDER BY ord) AS ids, count(*) AS n_rows,
  string_agg('r' || ord || ': n=' || regexp_extract(t, '<td>(\\d+)</td>', 1), '；' ORDER BY ord) FILTER (k <= 3) AS summary, arg_min(regexp_extract(t, '<caption>(.*)</caption>', 1), ord) AS caption FROM tables_b GROUP BY doc_id, no),
figs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS no FROM sec WHERE type = 'figure' AND {{figure}}),
names AS (SELECT doc_id, source, lang, {parsing._NAME_SQL} AS name, {parsing._CODE_SQL} AS code, {parsing._SUFFIX_SQL} AS suffix FROM documents),
files AS (SELECT doc_id, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS date, CASE WHEN contains(name, '证券') THEN '' ELSE name || '（' || code || '.' || suffix || '）' END AS company, CASE WHEN contains(name, '证券') THEN name || code ELSE '国金证券' END AS institution,
  CASE WHEN contains(name, '证券') THEN '国金证券' ELSE '' END || '深度报告 ' || lang || CASE WHEN doc_id % 2 = 0 THEN ' 买入' ELSE '' END AS title, CASE WHEN doc_id % 2 = 0 THEN '买入' ELSE '' END AS rating FROM names),
covers AS (SELECT doc_id, arg_min(regexp_extract(t, '{cascade.RATING}'), ord) FILTER (cover AND reason IS NULL AND regexp_matches(t, '{cascade.RATING}')) AS rating, min(page) FILTER (cover AND reason IS NULL) AS p0, max(page) FILTER (cover AND reason IS NULL) AS p1,
  string_agg('b' || ord, ',' ORDER BY ord) FILTER (cover AND reason IS NULL) AS ids, bool_or(reason IS NULL) AS any_kept FROM judged GROUP BY doc_id),
view_a AS (SELECT j.doc_id, j.ord, t, CASE WHEN len({_sentences('t')}) > 0 THEN {_sentences('t')} ELSE [t] END AS x FROM judged j JOIN covers c USING (doc_id)
  WHERE type IN ('text', 'title') AND page = 1 AND NOT contact AND NOT regexp_matches(t, '{typed.NO_VIEW}') AND NOT risk AND NOT {parsing._NOISY_COVER} AND (reason IS NULL OR NOT any_kept)),
view_b AS (SELECT doc_id, ord, unnest(range(len(x))) AS k, {_CLEAN.format('unnest(x)')} AS t FROM view_a),
views AS (SELECT v.doc_id, arg_min(v.t, v.ord * 100000 + v.k) AS view FROM (SELECT * FROM view_b WHERE length(t) >= {typed.VIEW_CHARS} AND NOT {parsing._NOISY_COVER}) v JOIN files f USING (doc_id) WHERE v.t NOT IN (f.title, f.company, f.institution) GROUP BY v.doc_id)
SELECT doc_id, chunk_type, no, page_start, page_end, section, subsection, ids, md5(text) AS digest FROM (
  SELECT doc_id, 'cover_summary_chunk' AS chunk_type, 1 AS no, coalesce(p0, 1) AS page_start, coalesce(p1, 1) AS page_end, '{typed.COVER_SECTION}' AS section, '' AS subsection, coalesce(ids, '') AS ids,
    concat_ws(chr(10), '标题：' || title, '公司：' || nullif(company, ''), '机构：' || institution, '日期：' || date, '评级：' || nullif(coalesce(c.rating, f.rating), ''), '核心观点：' || view) AS text FROM files f LEFT JOIN covers c USING (doc_id) LEFT JOIN views USING (doc_id)
  UNION ALL SELECT doc_id, 'text_chunk', row_number() OVER (PARTITION BY doc_id ORDER BY o, k), p0, p1, section, subsection, ids, text FROM texts JOIN firsts USING (doc_id, section, subsection)
  UNION ALL SELECT doc_id, 'raw_table_chunk', no, p0, p1, section, subsection, ids, html FROM tables
  UNION ALL SELECT doc_id, 'table_summary_chunk', no, p0, p1, section, subsection, ids, concat_ws(chr(10), '表名：' || caption, '所属章节：' || section, '前后文：' || nullif(context, ''), '关键指标：' || summary) FROM tables LEFT JOIN context USING (doc_id, ord)
  UNION ALL SELECT doc_id, 'figure_summary_chunk', no, page, page, section, subsection, 'b' || ord, concat_ws(chr(10), '图名：' || t, '所属章节：' || section, '图注上下文：' || nullif(context, ''), '趋势描述：' || t) FROM figs LEFT JOIN context USING (doc_id, ord))"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return typed.chunk_documents_typed(_classified(spark, sf), parsing._reports(spark, sf).withColumnRenamed("name", "source"), SIZE, 0)


@_register("typed_chunks", parsing._ruled(_TYPED_SQL))
def typed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Covers, texts, tables, summaries and figures of documents whose lines are read as a report's blocks; no overlap, which SQL can't follow."""
    rows = _chunks(spark, sf)
    return rows.select(
        "doc_id", "chunk_type", F.expr("ord & 4294967295").alias("no"), F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"),
        "section", "subsection", F.array_join("block_ids", ",").alias("ids"), F.md5("text").alias("digest"),
    )


# Parts as lines of a printed list: a row for each, 25 to a page, cells for name, brand, size and price; headings between, some cells missing.
_PRINTED = "SELECT p_partkey // 200 AS doc_id, p_partkey % 200 // 25 + 1 AS page, p_partkey % 25 AS k, p_name, p_brand, p_size, CAST(round(p_retailprice, 2) AS VARCHAR) AS price FROM part"


@_register(
    "table_regions",
    f"""WITH p AS ({_PRINTED}), r AS (SELECT *, k % 9 <> 4 AND p_size % 10 <> 0 AS tableish, CASE WHEN p_size % 4 = 1 THEN [p_name, p_brand, 's' || p_size] ELSE [p_name, p_brand, 's' || p_size, price] END AS cells FROM p),
g AS (SELECT *, count(*) FILTER (NOT coalesce(tableish AND was AND k = before + 1, false)) OVER (PARTITION BY doc_id, page ORDER BY k) AS region FROM (SELECT *, lag(tableish) OVER w AS was, lag(k) OVER w AS before FROM r WINDOW w AS (PARTITION BY doc_id, page ORDER BY k))),
t AS (SELECT doc_id, page, region, count(*) AS n_rows, max(len(cells)) AS n_columns, min(k) AS first, string_agg(array_to_string(cells, '|'), chr(10) ORDER BY k) AS body FROM g WHERE tableish GROUP BY ALL HAVING count(*) >= 5)
SELECT t.doc_id, t.page, row_number() OVER (PARTITION BY t.doc_id, t.page ORDER BY region) AS table_no, n_rows, n_columns, CASE WHEN a.k % 9 = 4 THEN 'List of ' || a.p_brand WHEN a.k IS NULL THEN '' ELSE a.p_brand END AS title, md5(body) AS digest FROM t LEFT JOIN r a ON a.doc_id = t.doc_id AND a.page = t.page AND a.k = t.first - 1""",
)
def table_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Tables found among the lines of printed lists, with the lines above them as titles."""
    k = F.col("p_partkey") % 25
    cell = lambda x0, x1, text: F.struct(F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), text.alias("text"))
    full = F.array(cell(40.0, 230.0, F.col("p_name")), cell(260.0, 330.0, F.col("p_brand")), cell(360.0, 390.0, F.concat(F.lit("s"), F.col("p_size").cast("string"))))
    price = F.array(cell(430.0, 500.0, F.round("p_retailprice", 2).cast("string")))
    cells = F.when(k % 9 == 4, F.array(cell(40.0, 230.0, F.concat(F.lit("List of "), "p_brand")))).when(F.col("p_size") % 10 == 0, F.slice(full, 1, 2)).when(F.col("p_size") % 4 == 1, full).otherwise(F.concat(full, price))
    rows = read(spark, sf, "part").select(F.expr("p_partkey DIV 200").alias("doc_id"), F.expr("p_partkey % 200 DIV 25 + 1").alias("page"), k.alias("k"), F.posexplode(cells).alias("at", "c"))
    lines = rows.select("doc_id", "page", (F.col("k") * 8 + F.col("at")).cast("int").alias("ord"), "c.x0", (40.0 + 28 * F.col("k") + F.col("at") % 2).alias("top"), "c.x1", (52.0 + 28 * F.col("k") + F.col("at") % 2).alias("bottom"), "c.text")
    pages = lines.select("doc_id", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height")).distinct()
    found = regions.dense_tables(lines, pages)
    body = F.array_join(F.transform("rows", lambda r: F.array_join(F.filter(r, lambda c: c != ""), "|")), "\n")
    return found.select("doc_id", "page", F.col("table_no").cast("long").alias("table_no"), F.size("rows").cast("long").alias("n_rows"), F.size(F.get("rows", 0)).cast("long").alias("n_columns"), "title", F.md5(body).alias("digest"))
