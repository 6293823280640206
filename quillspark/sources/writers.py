"""Sinks: index tables, result files, checkpoints and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions import text as T


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks by configuration (columns chunk_size and overlap)."""
    chunks.write.mode("overwrite").partitionBy("chunk_size", "overlap").parquet(path)


def write_index(store: DataFrame, vectors: DataFrame, meta: DataFrame, path: str) -> None:
    """The tables of an index under one folder; its ids join the docstore with the vectors."""
    for name, table in (("docstore", store), ("vectors", vectors), ("build_meta", meta)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def build_meta(store: DataFrame) -> DataFrame:
    """One row: documents, records, indexed records, and counts by chunk type."""
    by_type = store.groupBy("chunk_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_type", "n")))).alias("by_type"))
    total = store.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("records"), F.count_if("indexed").alias("indexed"))
    return total.crossJoin(by_type)  # one row each


def write_results(results: DataFrame, path: str, overwrite: bool = False) -> None:
    """Results by route; an existing folder is an error unless ``overwrite``."""
    results.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("route").json(path)


def append_checkpoint(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def without_sources(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """Chunks whose source is not among ``removed`` (source): what a rebuilt index holds."""
    return chunks.join(removed.select("source").distinct(), "source", "left_anti")


def rebuilt(store: DataFrame, vectors: DataFrame, removed: DataFrame, added: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(docstore, vectors) without the sources of ``removed`` (source) and with the records of ``added``, whose sources replace those that are there."""
    gone = removed.select(F.col("source").alias("source_pdf"))
    if added is not None:
        gone = gone.unionByName(added.select("source_pdf"))
    kept = store.join(gone.distinct(), "source_pdf", "left_anti").select(*store.columns)
    kept = kept if added is None else kept.unionByName(added.select(*store.columns))
    return kept, vectors.join(kept.select("docstore_id"), "docstore_id", "left_semi")


def new_sources(found: DataFrame, store: DataFrame) -> DataFrame:
    """Uploads (source, ...) that no record of the docstore comes from yet."""
    return found.join(store.select(F.col("source_pdf").alias("source")).distinct(), "source", "left_anti").select(*found.columns)


def write_per_query(results: DataFrame, path: str, overwrite: bool = False) -> None:
    """Results (query, route, ...) as JSON, a folder for each route and query, named by the query's slug."""
    rows = results.withColumn("slug", T.slug("query"))
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("route", "slug").json(path)


def write_answers(payloads: DataFrame, path: str, overwrite: bool = False, meta: dict | None = None) -> None:
    """Payloads (query_id, payload) as JSON lines below ``path``/records, and one JSON line of what they have in common in ``path``/run.

    A folder that is there already is an error unless ``overwrite``.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    payloads.select(F.col("payload").alias("value")).write.mode(mode).text(f"{path}/records")
    spark = payloads.sparkSession
    run = spark.range(1).select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in (meta or {}).items()), F.current_timestamp().cast("string").alias("timestamp"))).alias("value"))
    run.write.mode(mode).text(f"{path}/run")


def append_answers(payloads: DataFrame, path: str) -> None:
    """Payloads appended to the JSON lines of earlier calls."""
    payloads.select(F.col("payload").alias("value")).write.mode("append").text(f"{path}/records")


def write_parsed(parsed: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parsed documents (doc_id, source, method, page_sizes, blocks, any others) as JSON, a folder for each document's first two hash digits.

    ``readers.parsed_documents`` reads single files; these are read back with ``spark.read.json``.
    """
    rows = parsed.withColumn("part", F.left(F.md5(F.col("doc_id").cast("string")), F.lit(2)))
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("part").json(path)


def as_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown: a section for each block in order, with its type, page and box."""
    return _joined(blocks, F.concat(_head("### ", " | "), F.lit("\n\n"), F.col("text")), "markdown", "\n\n")


def _head(prefix: str, between: str):
    box = F.concat(F.lit("["), F.concat_ws(", ", *(F.col(c).cast("string") for c in ("x0", "top", "x1", "bottom"))), F.lit("]"))
    return F.concat(F.lit(prefix), F.concat_ws(between, "block_id", "type", F.concat(F.lit("page "), F.col("page").cast("string")), F.concat(F.lit("bbox "), box)))


def _joined(blocks: DataFrame, part, name: str, between: str) -> DataFrame:
    rows = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", part.alias("p")))).alias("parts"))
    return rows.select("doc_id", F.array_join(F.transform("parts", lambda p: p["p"]), between).alias(name))


def as_html(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, html: the boxes of blocks over their pages, in percent of the page's size, and their texts."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("'"), F.lit("&#x27;"))
    rows = blocks.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"], "left")
    width, height = F.greatest(F.coalesce("width", F.lit(1.0)), F.lit(1.0)), F.greatest(F.coalesce("height", F.lit(1.0)), F.lit(1.0))
    share = lambda x, of: F.format_string("%.4f%%", (x / of * 100).cast("double"))
    span = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(1.0))
    style = F.concat(
        F.lit("left:"), share(F.col("x0"), width), F.lit(";top:"), share(F.col("top"), height), F.lit(";width:"), share(span("x0", "x1"), width), F.lit(";height:"), share(span("top", "bottom"), height), F.lit(";")
    )
    label = escaped(F.concat_ws(" ", "block_id", "type"))
    box = F.concat(F.lit("<a class='box "), "type", F.lit("' href='#"), escaped(F.col("block_id")), F.lit("' style='"), style, F.lit("' title='"), label, F.lit("'>"), label, F.lit("</a>"))
    body = F.concat(F.lit("<section class='block "), "type", F.lit("' id='"), escaped(F.col("block_id")), F.lit("'><h3>"), label, F.lit(" · page "), F.col("page").cast("string"), F.lit("</h3><pre>"), escaped(F.col("text")), F.lit("</pre></section>"))
    by_page = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", box.alias("a"), body.alias("b")))).alias("x"))
    canvas = F.concat(F.lit("<section class='page'><h2>Page "), F.col("page").cast("string"), F.lit("</h2><div class='canvas'>"), F.array_join(F.transform("x", lambda p: p["a"]), ""), F.lit("</div></section>"))
    docs = by_page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", canvas.alias("c"), F.array_join(F.transform("x", lambda p: p["b"]), "").alias("b")))).alias("p"))
    text = lambda f: F.array_join(F.transform("p", lambda p: p[f]), "")
    return docs.select("doc_id", F.concat(F.lit("<!doctype html><html><head><meta charset='utf-8'></head><body>"), text("c"), text("b"), F.lit("</body></html>")).alias("html"))


def crops(blocks: DataFrame, pages: DataFrame, margin: float = 2.0) -> DataFrame:
    """doc_id, page, block_id, file, box: which part of which page an image of each table and figure would show, within the page."""
    rows = blocks.where("type IN ('table', 'figure')").join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    low, high = (lambda c: F.greatest(F.col(c) - margin, F.lit(0.0))), (lambda c, m: F.least(F.col(c) + margin, F.col(m)))
    file = F.concat_ws("_", T.slug(F.col("doc_id").cast("string")), "type", "block_id")
    return rows.select("doc_id", "page", "block_id", F.concat(file, F.lit(".png")).alias("file"), F.array(low("x0"), low("top"), high("x1", "width"), high("bottom", "height")).alias("box"))
