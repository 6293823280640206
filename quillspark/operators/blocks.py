"""Cleaning and sectioning of ordered document blocks (doc_id, ord, page, type, text, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.session import materialize

# What marks noise, and how often an edge text must repeat.
EDGE_LENGTH, EDGE_REPEATS, EDGE_TOP, EDGE_BOTTOM = 80, 3, 0.08, 0.92
DEFAULT_SECTION = "正文"
SOURCE_ONLY = r"^(资料来源|数据来源|来源)"


def lines_as_blocks(docs: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """Each line of a text as a block: doc_id, ord from 0, block_id, text."""
    rows = docs.select(F.col(key).alias("doc_id"), *keep, F.posexplode(F.split(text, "\n")).alias("ord", "text"))
    return rows.withColumn("block_id", F.concat(F.lit("b"), F.lpad((F.col("ord") + 1).cast("string"), 4, "0")))


def repeated_edges(blocks: DataFrame, by: list[str], repeats: int = EDGE_REPEATS, edge: Column | None = None) -> DataFrame:
    """Adds ``key`` and ``is_repeated``: short texts that come ``repeats`` times and more in a group, among its edge blocks."""
    at_edge = F.lit(True) if edge is None else edge
    rows = blocks.withColumn("key", T.edge_key("text"))
    # the key is made once: both sides of the join read what is written here
    rows = materialize(rows.withColumn("able__", at_edge & (F.length("key") > 0) & (F.length("key") <= EDGE_LENGTH)), "edges")
    # counted first, then joined: a hot text is one row of counts, not a window
    counts = rows.where("able__").groupBy(*by, "key").agg(F.count("*").alias("times")).where(F.col("times") >= repeats)
    rows = rows.join(counts, [*by, "key"], "left")
    return rows.withColumn("is_repeated", F.col("able__") & F.col("times").isNotNull()).drop("times", "able__")


def page_edge(top: Column, bottom: Column, height: Column) -> Column:
    return (top <= EDGE_TOP * height) | (bottom >= EDGE_BOTTOM * height)


def noise_reason(text: Column, kind: Column) -> Column:
    """Why a block is noise by itself; null if it is not. The first rule that holds counts."""
    t = T.clean_text(text)
    digits = F.regexp_count(t, F.lit(r"\d+"))
    return (
        F.when(t == "", "empty")
        .when(t.rlike(r"^[\d\s.．·…-]{1,16}$") | t.contains("目录") | ((digits >= 6) & t.rlike(r"[.．·…]{2,}")), "table_of_contents")
        .when((F.length(t) <= 160) & t.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "contact")
        .when(t.rlike(SOURCE_ONLY) & (F.length(t) <= 48), "source_only")
        .when((kind == "title") & (F.length(t) <= 2), "title_noise")
    )


def assign_sections(blocks: DataFrame, level: Column | None = None) -> DataFrame:
    """Adds section and subsection: titles carried forward, each level resetting those below."""
    lv = F.when(F.col("type") == "title", T.title_level("text") if level is None else level).otherwise(0)
    rows = blocks.withColumn("lv__", lv)
    titled = lambda n: F.when(n, T.clean_text("text"))
    doc = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("g1__", F.sum((F.col("lv__") == 1).cast("int")).over(doc))
    in1 = Window.partitionBy("doc_id", "g1__").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s1__", F.last(titled(F.col("lv__") == 1), True).over(in1)).withColumn("s2__", F.last(titled(F.col("lv__") == 2), True).over(in1))
    rows = rows.withColumn("g2__", F.sum((F.col("lv__") == 2).cast("int")).over(in1))
    in2 = Window.partitionBy("doc_id", "g1__", "g2__").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s3__", F.last(titled(F.col("lv__") >= 3), True).over(in2))
    return rows.select(
        *blocks.columns, F.coalesce("s1__", F.lit(DEFAULT_SECTION)).alias("section"), F.concat_ws(" / ", F.nullif("s2__", F.lit("")), F.nullif("s3__", F.lit(""))).alias("subsection")
    )


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two spans as a share of the narrower, whose width is at least 1."""
    width = F.greatest(F.least(a1 - a0, b1 - b0), F.lit(1.0))
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0)) / width


def nearest_texts(anchors: DataFrame, texts: DataFrame, count: int = 3) -> DataFrame:
    """anchor, side, n, text: the closest texts above and below each anchor on its page (columns doc_id, page, top, bottom)."""
    a = anchors.select("doc_id", "page", F.col("block_id").alias("anchor"), F.col("top").alias("a_top"), F.col("bottom").alias("a_bottom"))
    pairs = a.join(texts.select("doc_id", "page", "block_id", "top", "bottom", "text"), ["doc_id", "page"])
    side = F.when(F.col("bottom") <= F.col("a_top"), "above").when(F.col("top") >= F.col("a_bottom"), "below")
    distance = F.when(side == "above", F.col("a_top") - F.col("bottom")).otherwise(F.col("top") - F.col("a_bottom"))
    w = Window.partitionBy("doc_id", "anchor", "side").orderBy("distance", "block_id")
    rows = pairs.withColumn("side", side).withColumn("distance", distance).where("side IS NOT NULL").withColumn("n", F.row_number().over(w))
    return rows.where(F.col("n") <= count).select("doc_id", "anchor", "side", "n", "text")


def surrounding_sentences(anchors: DataFrame, texts: DataFrame, limit: int = 3, blocks: int = 3) -> DataFrame:
    """doc_id, anchor, context: the ``limit`` sentences closest to each anchor on its page, in order: those above it first, then those below.

    anchors, texts: doc_id, page, block_id, x0, top, bottom (texts: text). Sentences of the
    ``blocks`` nearest blocks on either side count, each once; anchors without any are left out.
    """
    near = nearest_blocks(anchors, texts, blocks)
    parts = near.select("doc_id", "anchor", "side", F.col("n").alias("k"), F.posexplode(F.transform(T.split_sentences("text"), T.clean_text)).alias("at", "s"))
    # above, the nearest block's last sentence comes first; below, the nearest block's first
    order = Window.partitionBy("doc_id", "anchor").orderBy(F.col("side") != "above", "k", F.when(F.col("side") == "above", -F.col("at")).otherwise(F.col("at")))
    first = parts.withColumn("o", F.row_number().over(order)).groupBy("doc_id", "anchor", "s").agg(F.min(F.struct("o", "side")).alias("m"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "anchor").orderBy("m.o"))).where(F.col("r") <= limit)
    place = F.when(F.col("m.side") == "above", -F.col("r")).otherwise(F.col("r"))
    rows = ranked.groupBy("doc_id", "anchor").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "s"))).alias("parts"))
    return rows.select("doc_id", "anchor", F.array_join(F.transform("parts", lambda p: p["s"]), " ").alias("context"))


def nearest_blocks(anchors: DataFrame, texts: DataFrame, count: int) -> DataFrame:
    """doc_id, anchor, side, n, text: the ``count`` texts of a page before each anchor, and after it, in order of their tops; n counts from the anchor."""
    a = anchors.select("doc_id", "page", F.col("block_id").alias("anchor"), F.col("top").alias("a_top"), F.col("bottom").alias("a_bottom"))
    pairs = a.join(texts.select("doc_id", "page", "block_id", "x0", "top", "bottom", "text"), ["doc_id", "page"])
    side = F.when(F.col("bottom") <= F.col("a_top"), "above").when(F.col("top") >= F.col("a_bottom"), "below")
    rows = pairs.withColumn("side", side).where("side IS NOT NULL").withColumn("up", F.col("side") == "above")
    key = lambda c: F.when(F.col("up"), -F.col(c)).otherwise(F.col(c))
    w = Window.partitionBy("doc_id", "anchor", "side").orderBy(key("top"), key("x0"), "block_id")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= count).select("doc_id", "anchor", "side", "n", "text")
