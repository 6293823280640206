"""Tables that show as rows of cells only: runs of rows on a page, their titles, and how far the region below a caption goes.

Lines: doc_id, page, ord, x0, top, x1, bottom, text. Pages: doc_id, page, width, height.
Rows, cells and runs are found in the JVM: a page's lines are an array of some hundred,
everything between pages is windows and joins keyed by the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators import layout, tables
from quillspark.operators.blocks import overlap_ratio

# How close lines of a cell stand, what makes a row and a run of rows a table, and how far titles and captions reach.
CELL_SHIFT, CELL_OVERLAP = 22, 0.35
ROW_CELLS, LABEL_WITHIN, LABEL_CHARS = 3, 0.42, 2
RUN_ROWS, RUN_GAP, RUN_GAP_HEIGHTS = 5, 18.0, 2.5
RUN_WIDTH, RUN_HEIGHT, RUN_NUMERIC, RUN_COVERED, RUN_MARGIN = 0.34, 45, 0.75, 0.35, 4
CONTACT_BELOW, CONTACT, CONTACT_TITLE = 0.50, r"电话|邮箱|地址|邮编|上海|北京|深圳|版权所有|此报告", r"电话|邮箱|地址|邮编|版权所有|此报告"
TITLE_ABOVE, TITLE_OVERLAP = 28, 0.15
CAPTION_LINES, CAPTION_REACH, CAPTION_NEXT, CAPTION_NEXT_HEIGHTS, CAPTION_FOOT = 90, 320, 28.0, 2.0, 0.92


def cells_of(lines: Column) -> Column:
    """array<string>: the cells of a row of lines array<struct<x0, top, x1, ord, text>>, from left to right.

    A line joins the first cell that begins close to it or overlaps it in width; the
    lines of a cell are joined from top to bottom.
    """
    part = "struct<top: double, x0: double, ord: int, text: string>"
    empty = F.array().cast(f"array<struct<x0: double, x1: double, parts: array<{part}>>>")

    def step(held: Column, s: Column) -> Column:
        item = F.struct(s["top"].cast("double").alias("top"), s["x0"].cast("double").alias("x0"), s["ord"].cast("int").alias("ord"), s["text"].alias("text"))
        shared = lambda g: F.greatest(F.least(g["x1"], s["x1"]) - F.greatest(g["x0"], s["x0"]), F.lit(0.0))
        fits = lambda g: (F.abs(s["x0"] - g["x0"]) < CELL_SHIFT) | (shared(g) > CELL_OVERLAP * F.least(s["x1"] - s["x0"], F.greatest(F.lit(1.0), g["x1"] - g["x0"])))
        at = F.array_position(F.transform(held, fits), True)
        wider = lambda g: F.struct(F.least(g["x0"], s["x0"]).alias("x0"), F.greatest(g["x1"], s["x1"]).alias("x1"), F.array_append(g["parts"], item).alias("parts"))
        new = F.struct(s["x0"].cast("double").alias("x0"), s["x1"].cast("double").alias("x1"), F.array(item).alias("parts"))
        return F.when(at == 0, F.array_append(held, new)).otherwise(F.transform(held, lambda g, i: F.when(i + 1 == at, wider(g)).otherwise(g)))

    in_order = F.array_sort(F.filter(lines, lambda s: T.strip(s["text"]) != ""))
    return F.transform(F.aggregate(in_order, empty, step), lambda g: layout.join_lines(F.transform(F.array_sort(g["parts"]), lambda p: p["text"])))


def rows_of_cells(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, row_no, x0, top, x1, bottom, cells, n_lines, n_numeric, text, tableish: the visual rows of pages, sources left out.

    A row is like a table's if it has three cells and a label on the left that is no number.
    """
    held = layout.visual_rows(lines.where(~layout.looks_like_source(F.col("text")))).join(pages.select("doc_id", "page", F.col("width").alias("w__")), ["doc_id", "page"])
    numeric, line = layout.is_numeric_fragment(F.col("text")), F.struct("x0", "top", "x1", "ord", "text")
    label = ~numeric & ((F.col("x0") + F.col("x1")) / 2 < LABEL_WITHIN * F.col("w__")) & (F.length(T.strip("text")) >= LABEL_CHARS)
    rows = held.groupBy("doc_id", "page", "row_no").agg(
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.array_sort(F.collect_list(line)).alias("lines"),
        F.count("*").alias("n_lines"), F.count_if(numeric).alias("n_numeric"), F.bool_or(label).alias("label"),
    )
    rows = rows.withColumns({"cells": cells_of(F.col("lines")), "text": F.array_join(F.col("lines.text"), " ")})
    return rows.withColumn("tableish", (F.size("cells") >= ROW_CELLS) & F.col("label")).drop("lines", "label")


def nearest_titles(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds ``title`` to regions (doc_id, page, x0, top, x1): the closest line above within 28 points that overlaps them in width and is no number; empty without one."""
    t = lines.where(~layout.is_numeric_fragment(F.col("text"))).select("doc_id", "page", F.col("ord").alias("t_ord"), F.col("x0").alias("t_x0"), F.col("x1").alias("t_x1"), F.col("bottom").alias("t_bottom"), F.col("text").alias("t_text"))
    away = F.col("top") - F.col("t_bottom")
    near = (away >= 0) & (away <= TITLE_ABOVE) & (overlap_ratio(F.col("x0"), F.col("x1"), F.col("t_x0"), F.col("t_x1")) > TITLE_OVERLAP)
    key = [c for c in ("doc_id", "page", "region") if c in regions.columns]
    best = regions.join(t, ["doc_id", "page"]).where(near).groupBy(*key).agg(F.min_by("t_text", F.struct(away.alias("away"), (-F.length("t_text")).alias("n"), "t_ord")).alias("title"))
    return regions.join(best, key, "left").withColumn("title", F.coalesce("title", F.lit("")))


def dense_tables(lines: DataFrame, pages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """doc_id, page, table_no, table_id, x0, top, x1, bottom, rows, title, text of runs of five rows and more that are tables.

    existing: tables that are known already (doc_id, page, x0, top, x1, bottom); a run that
    covers, or is covered by, more than a third of one is none. Runs of contact lines at the
    foot, narrow or flat ones and those of numbers only aren't either. Short rows are filled.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("row_no")
    lag = lambda c: F.lag(c).over(w)
    rows = rows_of_cells(lines, pages)
    gap = F.greatest(F.lit(RUN_GAP), RUN_GAP_HEIGHTS * (lag("bottom") - lag("top")))
    goes_on = F.coalesce(F.col("tableish") & lag("tableish") & (F.col("top") - lag("bottom") <= gap), F.lit(False))
    rows = rows.withColumn("region", F.sum(F.when(goes_on, 0).otherwise(1)).over(w)).where("tableish")
    runs = rows.groupBy("doc_id", "page", "region").agg(
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.count("*").alias("n"), F.sum("n_lines").alias("n_lines"), F.sum("n_numeric").alias("n_numeric"),
        F.array_sort(F.collect_list(F.struct("row_no", "cells", "text"))).alias("held"),
    )
    runs = runs.join(pages.select("doc_id", "page", F.col("width").alias("w__"), F.col("height").alias("h__")), ["doc_id", "page"])
    contact = (F.col("top") > CONTACT_BELOW * F.col("h__")) & F.array_join(F.col("held.text"), " ").rlike(CONTACT)
    sized = (F.col("x1") - F.col("x0") >= RUN_WIDTH * F.col("w__")) & (F.col("bottom") - F.col("top") >= RUN_HEIGHT)
    runs = runs.where((F.col("n") >= RUN_ROWS) & ~contact & sized & (F.col("n_numeric") / F.col("n_lines") <= RUN_NUMERIC))
    if existing is not None:
        for a, b in (("a", "b"), ("b", "a")):
            mine, other = layout._boxed(runs, a), layout._boxed(existing, b).select("doc_id", "page", *(f"{b}_{n}" for n in ("x0", "top", "x1", "bottom")))
            runs = mine.join(other, (mine["doc_id"] == other["doc_id"]) & (mine["page"] == other["page"]) & (layout.area_overlap("a", "b") > RUN_COVERED), "left_anti").select(*runs.columns)
    runs = nearest_titles(runs, lines).where(~F.col("title").rlike(CONTACT_TITLE))
    wide = F.array_max(F.transform("held", lambda r: F.size(r["cells"])))
    runs = runs.withColumn("rows", F.transform("held", lambda r: F.concat(r["cells"], F.array_repeat(F.lit(""), wide - F.size(r["cells"])))))
    no = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("region"))
    table = tables.to_markdown(F.get("rows", 0), F.slice("rows", 2, F.size("rows")))
    inside = lambda c, most=None: F.greatest(F.col(c) - RUN_MARGIN, F.lit(0.0)) if most is None else F.least(F.col(c) + RUN_MARGIN, F.col(most))
    return runs.withColumn("table_no", no).select(
        "doc_id", "page", "table_no", F.format_string("p%d_dense_table_%d", F.col("page").cast("int"), F.col("table_no").cast("int")).alias("table_id"),
        inside("x0").alias("x0"), inside("top").alias("top"), inside("x1", "w__").alias("x1"), inside("bottom", "h__").alias("bottom"), "rows", "title",
        F.concat_ws("\n", F.nullif("title", F.lit("")), table).alias("text"),
    )


def caption_regions(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, ord, after: for each caption, the place in its page of the first line that is not of its region any more.

    That is the first line far below, at the page's foot, or a caption further down; at
    most 90 lines on, or the page's end. Lines count in the order of ``ord``.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    rows = lines.withColumns({"place": F.row_number().over(w).cast("int") - 1, "n": F.count("*").over(Window.partitionBy("doc_id", "page")).cast("int"), "captioned": layout.looks_like_caption(F.col("text"))})
    rows = rows.join(pages.select("doc_id", "page", F.col("height").alias("h__")), ["doc_id", "page"])
    caption = rows.where("captioned").select("doc_id", "page", "ord", "n", F.col("place").alias("from"), F.col("top").alias("c_top"), (F.col("bottom") - F.col("top")).alias("c_high"))
    below = rows.select("doc_id", "page", "place", "top", "captioned", "h__")
    away = F.col("top") - F.col("c_top")
    ends = (away > CAPTION_REACH) | (F.col("captioned") & (away > F.greatest(F.lit(CAPTION_NEXT), CAPTION_NEXT_HEIGHTS * F.col("c_high")))) | (F.col("top") > CAPTION_FOOT * F.col("h__"))
    met = caption.join(below, ["doc_id", "page"], "left").where((F.col("place") > F.col("from")) & (F.col("place") < F.col("from") + CAPTION_LINES) & ends)
    first = met.groupBy("doc_id", "page", "ord").agg(F.min("place").alias("end"))
    return caption.join(first, ["doc_id", "page", "ord"], "left").select("doc_id", "page", "ord", F.coalesce("end", F.least("n", F.col("from") + CAPTION_LINES)).alias("after"))
