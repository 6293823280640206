"""Chunks of every kind from one table of classified blocks: covers, texts, tables, tables' summaries and figures.

Classified blocks: doc_id, ord, block_id, page, type, x0, top, x1, bottom, text, is_cover,
reason (null: kept). They are written once; each stream reads the columns and the blocks
it needs, and all streams end in one chunk schema that ``index.docstore_records`` takes.
Ids count from 1 in each document and kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators import blocks, cascade, chunking, index, layout, tables
from quillspark.session import materialize

# Kinds of chunks, labels of their lines, and the words of a cover that are no view.
TEXT, FIGURE = "text_chunk", "figure_summary_chunk"
COVER_SECTION = "封面"
SECTION_LABEL, SUMMARY_LABEL, FIGURE_LABEL, FIGURE_CONTEXT_LABEL, TREND_LABEL = "所属章节：", "关键指标：", "图名：", "图注上下文：", "趋势描述："
INSTITUTION_LABEL, DATE_LABEL, RATING_LABEL, VIEW_LABEL = "机构：", "日期：", "评级：", "核心观点："
NO_VIEW = r"相关研究报告|市场回顾|投资策略"
VIEW_CHARS, CONTEXT_SENTENCES = 20, 3
#: The streams in the order of a document's chunks.
STREAMS = ("cover_summary", "text", "raw_table", "table_summary", "figure_summary")
COLUMNS = (
    "doc_id", "ord", "chunk_id", "chunk_type", "text", "page_start", "page_end", "section", "subsection", "block_ids", "table_id", "figure_id", "caption", "context", "n_rows",
)


def _labelled(*lines: tuple[str, Column]) -> Column:
    """The lines that have a text, each behind its label."""
    return F.concat_ws("\n", *(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c)) for label, c in lines))


def _stream(rows: DataFrame, kind: str, chunk_type: str, order: list, **fields: Column) -> DataFrame:
    """A stream's rows in the common schema, numbered in their documents by ``order``."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    place = (F.lit(STREAMS.index(kind)).cast("long") * (1 << 32) + F.col("n__")).alias("ord")
    rows = rows.withColumn("n__", n)
    none = {"table_id": "string", "figure_id": "string", "caption": "string", "context": "string", "n_rows": "int"}
    given = {**{c: F.lit(None).cast(t) for c, t in none.items()}, **fields}
    return rows.select(
        "doc_id", place, T.chunk_id(F.col("doc_id").cast("string"), kind, F.col("n__")).alias("chunk_id"), F.lit(chunk_type).alias("chunk_type"), *(given[c].alias(c) for c in COLUMNS[4:])
    )


def cover_chunks(classified: DataFrame, sources: DataFrame) -> DataFrame:
    """A chunk for each document of sources (doc_id, source: the file's name) that says what its name and its cover tell.

    The name comes first, then the cover's blocks: its first title, the first rating on
    it, the first broker of any block of it, dropped ones too.
    """
    t, cover, kept = F.col("text"), F.col("is_cover"), F.col("reason").isNull()
    first = lambda value, where: F.min_by(value, F.when(where, F.col("ord")))
    found = classified.groupBy("doc_id").agg(
        first(T.clean_text(t), cover & kept & (F.col("type") == "title") & (T.clean_text(t) != "")).alias("title"),
        first(F.regexp_extract(t, f"({cascade.RATING})", 1), cover & kept & t.rlike(cascade.RATING)).alias("rating"),
        first(T.clean_text(t), cover & cascade.is_broker_name(t)).alias("broker"),
        F.min(F.when(cover & kept, F.col("page"))).alias("first"), F.max(F.when(cover & kept, F.col("page"))).alias("last"),
        F.transform(F.array_sort(F.collect_list(F.when(cover & kept, F.struct("ord", "block_id")))), lambda b: b["block_id"]).alias("block_ids"), F.bool_or(kept).alias("any_kept"),
    )
    rows = sources.select("doc_id", layout.file_fields(F.col("source")).alias("f")).join(found, "doc_id", "left")
    rows = rows.join(_views(classified, rows), "doc_id", "left")
    pick = lambda *options: F.coalesce(*(F.nullif(o, F.lit("")) for o in options))
    text = _labelled(
        (index.TITLE_LABEL, pick(F.col("f.title"), F.col("title"), F.col("f.company"), F.col("doc_id").cast("string"))), (index.COMPANY_LABEL, F.col("f.company")),
        (INSTITUTION_LABEL, pick(F.col("f.institution"), F.col("broker"))), (DATE_LABEL, F.col("f.date")), (RATING_LABEL, pick(F.col("rating"), F.col("f.rating"))), (VIEW_LABEL, F.col("view")),
    )
    ids = F.coalesce("block_ids", F.array().cast("array<string>"))
    return _stream(
        rows, "cover_summary", index.COVER, [F.lit(1)], text=text, page_start=F.coalesce("first", F.lit(1)), page_end=F.coalesce("last", F.lit(1)), section=F.lit(COVER_SECTION), subsection=F.lit(""), block_ids=ids
    )


def _views(classified: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, view: the first sentence of the first page that is long enough and neither noise nor what the file's name says.

    Only kept blocks count, in documents that have any.
    """
    t = F.col("text")
    words = F.col("type").isin("text", "title") & (F.col("page") == 1) & ~cascade.is_analyst_contact(t) & ~t.rlike(f"{NO_VIEW}|{cascade.RISK}") & ~cascade.is_noisy_cover(t)
    rows = classified.where(words).join(documents.select("doc_id", "f", "any_kept"), "doc_id").where(F.col("reason").isNull() | ~F.coalesce("any_kept", F.lit(False)))
    sentences = T.split_sentences("text")
    rows = rows.select("doc_id", "ord", "f", F.posexplode(F.when(F.size(sentences) > 0, sentences).otherwise(F.array("text"))).alias("k", "s")).withColumn("text", T.clean_text("s"))
    named = F.col("text").isin(F.col("f.title"), F.col("f.company"), F.col("f.institution"))
    return layout.cover_view(rows.select("doc_id", F.struct("ord", "k").alias("ord"), "text", named.alias("named")), F.col("named") | cascade.is_noisy_cover(F.col("text")), VIEW_CHARS)


def text_chunks(sectioned: DataFrame, size: int, overlap: int) -> DataFrame:
    """Texts with the titles before them, packed by section; sections in the order in which they first appear."""
    rows = sectioned.where("type IN ('text', 'title')")
    key = ["doc_id", "section", "subsection"]
    packed = chunking.chunk_sections(chunking.section_units(rows), size, overlap)
    packed = packed.join(rows.groupBy(*key).agg(F.min("ord").alias("first__")), key)
    return _stream(packed, "text", TEXT, ["first__", "chunk_no"], **{c: F.col(c) for c in ("text", "page_start", "page_end", "section", "subsection", "block_ids")})


def table_chunks(sectioned: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, summaries): a chunk with the HTML of each logical table, and one with its name, section, surroundings and first figures."""
    held = sectioned.where("type = 'table'")
    logical = tables.merge_over_pages(held.select("doc_id", "ord", "page", "section", "subsection", "block_id", F.col("text").alias("html"), tables.parse(F.col("text")).alias("table")))
    logical = logical.withColumn("anchor", F.get("block_ids", 0)).withColumn("table_id", F.concat(F.lit("table_"), F.lpad(F.col("table_no").cast("string"), 4, "0")))
    around = blocks.surrounding_sentences(held, texts, CONTEXT_SENTENCES)
    rows = logical.where("html != ''").join(around, ["doc_id", "anchor"], "left")
    rows = rows.withColumns({"caption": F.coalesce("caption", F.lit("")), "context": F.coalesce("context", F.lit("")), "headers": F.coalesce("headers", F.array().cast("array<array<string>>"))})
    same = {c: F.col(c) for c in ("page_start", "page_end", "section", "subsection", "block_ids", "table_id")}
    raw = _stream(rows, "raw_table", index.RAW_TABLE, ["table_no"], text=F.col("html"), caption=F.col("caption"), context=F.col("context"), n_rows=F.size("rows"), **same)
    summary = _labelled((index.CAPTION_LABEL, F.col("caption")), (SECTION_LABEL, F.col("section")), (index.CONTEXT_LABEL, F.col("context")), (SUMMARY_LABEL, tables.summary(F.struct("caption", "headers", "rows"))))
    return raw, _stream(rows, "table_summary", index.TABLE_SUMMARY, ["table_no"], text=summary, **same)


def figure_chunks(sectioned: DataFrame, texts: DataFrame) -> DataFrame:
    """A chunk with the title, section, surroundings and trend of each figure that says something."""
    t = F.col("text")
    held = sectioned.where((F.col("type") == "figure") & cascade.is_meaningful_figure(t))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    rows = held.withColumn("figure_id", F.concat(F.lit("figure_"), F.lpad(no.cast("string"), 4, "0"))).withColumn("title__", cascade.figure_title(t)).where("title__ != ''")
    rows = rows.join(blocks.surrounding_sentences(rows, texts, CONTEXT_SENTENCES).withColumnRenamed("anchor", "block_id"), ["doc_id", "block_id"], "left")
    text = _labelled((FIGURE_LABEL, F.col("title__")), (SECTION_LABEL, F.col("section")), (FIGURE_CONTEXT_LABEL, F.col("context")), (TREND_LABEL, cascade.figure_trend(t)))
    return _stream(
        rows, "figure_summary", FIGURE, ["ord"], text=text, page_start=F.col("page"), page_end=F.col("page"), section=F.col("section"), subsection=F.col("subsection"), block_ids=F.array("block_id"), figure_id=F.col("figure_id")
    )


def chunk_documents_typed(classified: DataFrame, sources: DataFrame, size: int = 512, overlap: int = 100, figures: bool = True) -> DataFrame:
    """Chunks of all kinds of classified blocks; sources: doc_id, source (the file's name), a row for each document.

    Blocks of the cover make the cover's chunk and no others, but their texts are
    surroundings of tables and figures. A document without blocks has a cover chunk only.
    """
    held = materialize(classified.select("doc_id", "ord", "block_id", "page", "type", "x0", "top", "x1", "bottom", "text", "is_cover", "reason"), "classified")
    kept = held.where("reason IS NULL")
    sectioned = materialize(blocks.assign_sections(kept.where("NOT is_cover")), "sectioned")
    texts = kept.where("type = 'text'")
    streams = [cover_chunks(held, sources), text_chunks(sectioned, size, overlap), *table_chunks(sectioned, texts)]
    streams += [figure_chunks(sectioned, texts)] if figures else []
    out = streams[0]
    for stream in streams[1:]:
        out = out.unionByName(stream)
    return out
