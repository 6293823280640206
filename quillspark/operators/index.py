"""From chunks to an index's docstore: fields of documents, links between tables and their summaries, what is indexed and what is skipped.

Chunks: doc_id, ord, chunk_id, chunk_type, text, and optional table_id, caption, context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators import lexical

# Kinds of chunks and the labels of their lines.
COVER, RAW_TABLE, TABLE_SUMMARY = "cover_summary_chunk", "raw_table_chunk", "table_summary_chunk"
INDEXED = ("text_chunk", "raw_table_chunk")
TITLE_LABEL, COMPANY_LABEL, CAPTION_LABEL, CONTEXT_LABEL = "标题：", "公司：", "表名：", "前后文："


def labelled_line(text: Column, label: str) -> Column:
    """What follows a label in the first line that begins with it and has anything else; null without one."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), T.strip)
    found = F.transform(F.filter(lines, lambda x: x.startswith(label)), lambda x: T.strip(F.substr(x, F.lit(len(label) + 1))))
    return F.get(F.filter(found, lambda x: x != ""), 0)


def document_fields(chunks: DataFrame) -> DataFrame:
    """doc_id, title, company: the first that a document's cover chunks name.

    Without one the title is that of the first embedding text which begins with one (where
    there is such a column), else that of the id; the company is empty.
    """
    cover = F.col("chunk_type") == COVER
    embedded = T.first_nonempty_line("embedding_text") if "embedding_text" in chunks.columns else F.lit("")
    rows = chunks.select(
        "doc_id", "ord", F.when(cover, labelled_line(F.col("text"), TITLE_LABEL)).alias("t"), F.when(cover, labelled_line(F.col("text"), COMPANY_LABEL)).alias("c"),
        labelled_line(embedded, TITLE_LABEL).alias("e"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    fields = rows.groupBy("doc_id").agg(first("t").alias("t"), first("e").alias("e"), first("c").alias("c"))
    return fields.select("doc_id", F.coalesce("t", "e", T.title_from_id(F.col("doc_id").cast("string"))).alias("title"), F.coalesce("c", F.lit("")).alias("company"))


def _last(rows: DataFrame, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("ord"))
    return rows.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def table_notes(chunks: DataFrame) -> DataFrame:
    """doc_id, table_id, note_caption, note_context: what the last summary of each table says."""
    rows = _last(chunks.where((F.col("chunk_type") == TABLE_SUMMARY) & (F.coalesce("table_id", F.lit("")) != "")), "doc_id", "table_id")
    return rows.select("doc_id", "table_id", labelled_line(F.col("text"), CAPTION_LABEL).alias("note_caption"), labelled_line(F.col("text"), CONTEXT_LABEL).alias("note_context"))


def raw_tables(chunks: DataFrame) -> DataFrame:
    """doc_id, table_id, raw_chunk_id, raw_text: the last raw chunk of each table."""
    rows = _last(chunks.where((F.col("chunk_type") == RAW_TABLE) & (F.coalesce("table_id", F.lit("")) != "")), "doc_id", "table_id")
    return rows.select("doc_id", "table_id", F.col("chunk_id").alias("raw_chunk_id"), F.col("text").alias("raw_text"))


def linked_tables(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (doc_id, chunk_type, table_id, ...) with raw_chunk_id and raw_text of the table that a summary is of; null for others."""
    rows = hits.withColumn("of__", F.when(F.col("chunk_type") == TABLE_SUMMARY, F.col("table_id")))
    return rows.join(raw_tables(chunks).withColumnRenamed("table_id", "of__"), ["doc_id", "of__"], "left").select(*hits.columns, "raw_chunk_id", "raw_text")


def docstore_records(chunks: DataFrame, include: tuple[str, ...] = INDEXED) -> DataFrame:
    """Every chunk with embedding_text, indexed and skip_reason (null if indexed).

    Chunks of other kinds than ``include``, and blank ones, are kept and not indexed.
    """
    fields, notes = document_fields(chunks), table_notes(chunks)
    rows = chunks.join(fields, "doc_id", "left").join(notes, ["doc_id", "table_id"], "left")
    table = F.col("chunk_type") == RAW_TABLE
    caption = F.coalesce("note_caption", T.strip(F.coalesce("caption", F.lit(""))))
    body = T.strip(F.coalesce("text", F.lit("")))
    text = lexical.embedding_text(F.col("title"), F.col("company"), F.when(table, F.col("note_context")), F.when(table, caption), body)
    reason = F.when(~F.col("chunk_type").isin(*include), F.concat(F.lit("excluded_chunk_type:"), "chunk_type")).when(body == "", "empty_text")
    return rows.withColumn("embedding_text", text).withColumn("skip_reason", reason).withColumn("indexed", F.col("skip_reason").isNull()).drop("note_caption", "note_context")


def load_summary(records: DataFrame) -> DataFrame:
    """kind, name, n: chunks by type, indexed ones by type, skipped ones by reason, and summaries of tables whose raw chunk is there."""
    by = lambda kind, rows, name: rows.groupBy(F.lit(kind).alias("kind"), name.alias("name")).agg(F.count("*").alias("n"))
    keyed = records.where((F.col("chunk_type") == TABLE_SUMMARY) & (F.coalesce("table_id", F.lit("")) != ""))
    matched = keyed.join(raw_tables(records).select("doc_id", "table_id"), ["doc_id", "table_id"], "left_semi")
    return (
        by("all", records, F.col("chunk_type"))
        .unionByName(by("indexed", records.where("indexed"), F.col("chunk_type")))
        .unionByName(by("skipped", records.where("NOT indexed"), F.col("skip_reason")))
        .unionByName(by("tables", keyed, F.lit("summaries")))
        .unionByName(by("tables", matched, F.lit("matched")))
    )
