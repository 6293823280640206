"""Page geometry: covers, tables of contents, paragraphs, reading order and regions, of lines and blocks with boxes.

Lines: doc_id, page, ord, x0, top, x1, bottom, text. Blocks add type and block_id. Pages:
doc_id, page, width, height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators.blocks import overlap_ratio

# Shares of the page, sizes and words that results depend on.
PAGE = (595.0, 842.0)
COVER_TOP, COVER_CHARS, COVER_SIDE, COVER_SIDE_BOTTOM = 0.20, 120, 0.60, 0.38
TABLE_OVERLAP, VISUAL_OVERLAP, COLUMN_OVERLAP = 0.18, 0.15, 0.20
STOCK_SUFFIXES = (
    ("BJ", ("920", "430", "830", "831", "832", "833", "834", "835", "836", "837", "838", "839", "870", "871", "872", "873", "874", "875", "876", "877", "878", "879")),
    ("SH", ("600", "601", "603", "605", "688", "689", "900")),
    ("SZ", ("000", "001", "002", "003", "300", "301", "200")),
)
RATING = r"(优于大市|强于大市|买入|增持|中性|持有|减持|卖出|弱于大市)"
# Fixed values of lines: margins as shares of the page with the most characters there, gaps as multiples of the line's height.
MARGIN_LEFT, MARGIN_LEFT_WIDTH, MARGIN_LEFT_CHARS = 0.08, 20, 2
MARGIN_TOP, MARGIN_TOP_CHARS, MARGIN_BOTTOM, MARGIN_BOTTOM_CHARS, OFF_LEFT, OFF_RIGHT = 0.035, 6, 0.965, 12, 0.055, 0.96
PAGE_NUMBER = r"^(?:[-—_ ]*\d{1,4}[-—_ ]*|第?\s*\d{1,4}\s*页)$"
EDGE_ZONES, EDGE_PAGES, EDGE_SHARE, EDGE_KEY = (0.12, 0.90), 2, 0.3, (4, 80)
SAME_BAND, DETACHED_ROW, DETACHED_SIDE, GAP, GAP_APART, INDENT, LINE_HEIGHT = 0.22, 0.85, 4.0, 2.2, 0.35, 3.5, 10.0
HEADING, HEADING_CHARS = r"^([一二三四五六七八九十]+[、.．]|[0-9]+[.．、]|第.+[章节])", 42
PLAIN_HEADING_CHARS, PLAIN_HEADING_FONT, NO_HEADING = 28, 16, "[。；;:：,.，、]"
BULLET = "[\uf06c•●◆◼▪-]"
CAPTION, FIGURE_CAPTION = rf"^{BULLET}?\s*(图表|图|表)(\s*\d+)?[:：]", rf"^{BULLET}?\s*图(\s*\d+)?[:：]"
TABLE_TITLE, SOURCE = rf"^{BULLET}?\s*(图表|表)\s*\d*[:：]", r"^(资料来源|数据来源|来源)[:：]"
UNCAPTIONED = r"公司基本情况|主要财务指标|财务摘要|盈利预测与估值"
NUMERIC = r"^[-+0-9.,%/ ]+$|^(\d{4}[-/]\d{1,2}[-/]\d{1,2}\s*)+$"
NEW_SECTION = r"^([一二三四五六七八九十]+[、.．]|[0-9]+[、.．]|第.+[章节]|图表|图|表)"
CONTINUES_BELOW, CONTINUES_ABOVE, CONTINUES_SHIFT = 0.78, 0.24, 42
TABLE_BELOW, TABLE_ABOVE, TABLE_SHIFT = 0.76, 0.24, 70
ROW_HEIGHT, ROW_SHARE = 8.0, 0.75
SPLIT_LINES, SPLIT_SIDE, SPLIT_GAP, SPLIT_WITHIN = 8, 4, 0.09, (0.20, 0.75)
SPLIT_SPREAD, SPLIT_CENTRE_GAP, SPLIT_CENTRE_WITHIN = 0.18, 0.16, (0.32, 0.68)
BODY_WIDTH, BODY_SHARE, FULL_WIDTH = 20, 0.72, 0.68
# Fixed values of tables: rows, columns, filled cells and characters at least; the box at least; what is a column or a page of text instead.
LEAST_ROWS, LEAST_COLUMNS, LEAST_FILLED, LEAST_CHARS = 2, 2, 4, 16
LEAST_WIDTH, LEAST_WIDTH_SHARE, LEAST_HEIGHT = 90.0, 0.16, 18
COLUMN_HEIGHT, COLUMN_WIDTH = 0.82, 0.18
PAGE_WIDTH, PAGE_HEIGHT, PAGE_ROWS, PAGE_CELL = 0.86, 0.62, 8, 180
PROSE_CELL, PROSE_ROWS = 420, 12
POSITION_TAG = r"@@[0-9-]+\t[0-9.\t]+##"


def cover_blocks(blocks: DataFrame, pages: DataFrame, side_text: Column | None = None) -> DataFrame:
    """doc_id, block_id of first-page blocks at the top that are titles or short, or in the upper right corner."""
    rows = blocks.where("page = 1").join(pages, ["doc_id", "page"], "left")
    w, h = F.coalesce("width", F.lit(PAGE[0])), F.coalesce("height", F.lit(PAGE[1]))
    upper = (F.col("top") <= COVER_TOP * h) & ((F.col("type") == "title") | (F.length("text") <= COVER_CHARS))
    corner = (F.col("x0") >= COVER_SIDE * w) & (F.col("bottom") <= COVER_SIDE_BOTTOM * h) & (F.lit(True) if side_text is None else side_text)
    return rows.where(upper | corner).select("doc_id", "block_id")


def follows_in_column(block: dict[str, Column], anchor: dict[str, Column], width: Column) -> Column:
    """Whether a block stands below an anchor on its page, in its column: both in the right part, or overlapping in width."""
    right = (block["x0"] >= 0.55 * width) & (anchor["x0"] >= 0.55 * width)
    shared = overlap_ratio(block["x0"], block["x1"], anchor["x0"], anchor["x1"]) >= COLUMN_OVERLAP
    return (block["page"] == anchor["page"]) & (block["top"] >= anchor["bottom"]) & (right | shared)


def area_overlap(a: str, b: str) -> Column:
    """Shared area of two boxes (columns a_x0, a_top, ...) as a share of the first."""
    c = lambda p, n: F.col(f"{p}_{n}")
    wide = F.greatest(F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")), F.lit(0.0))
    high = F.greatest(F.least(c(a, "bottom"), c(b, "bottom")) - F.greatest(c(a, "top"), c(b, "top")), F.lit(0.0))
    return wide * high / F.greatest((c(a, "x1") - c(a, "x0")) * (c(a, "bottom") - c(a, "top")), F.lit(1.0))


def _boxed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("*", *(F.col(n).alias(f"{prefix}_{n}") for n in ("x0", "top", "x1", "bottom")))


def outside_regions(rows: DataFrame, regions: DataFrame, share: float) -> DataFrame:
    """Rows that no region of their page covers by ``share``: a range anti-join, keyed by the page."""
    a, b = _boxed(rows, "a"), _boxed(regions, "b").select("doc_id", "page", *(f"b_{n}" for n in ("x0", "top", "x1", "bottom")))
    on = (a["doc_id"] == b["doc_id"]) & (a["page"] == b["page"]) & (area_overlap("a", "b") >= share)
    return a.join(b, on, "left_anti").select(*rows.columns)


def merge_visual_tables(pdf: DataFrame, visual: DataFrame) -> DataFrame:
    """Visual tables and those of the PDF that they do not cover."""
    return visual.unionByName(outside_regions(pdf, visual, VISUAL_OVERLAP))


def is_page_number(text: Column) -> Column:
    return T.strip(text).rlike(PAGE_NUMBER)


def in_margin(width: Column, height: Column) -> Column:
    """Short lines in the margins, and any outside them (columns x0, top, x1, bottom, text)."""
    n, wide = F.length("text"), F.col("x1") - F.col("x0")
    left = (wide < MARGIN_LEFT_WIDTH) & (F.col("x0") < MARGIN_LEFT * width) & (n <= MARGIN_LEFT_CHARS)
    above, below = (F.col("top") < MARGIN_TOP * height) & (n <= MARGIN_TOP_CHARS), (F.col("bottom") > MARGIN_BOTTOM * height) & (n <= MARGIN_BOTTOM_CHARS)
    return left | above | below | (F.col("x1") < OFF_LEFT * width) | (F.col("x0") > OFF_RIGHT * width)


def header_footer_key(text: Column) -> Column:
    """What repeated lines at the edges have in common: no blanks, numbers masked; empty if that is too short."""
    key = F.regexp_replace(F.regexp_replace(text, r"\d+", "#"), r"(?U)\s+", "")
    return F.when(F.length(key) < EDGE_KEY[0], "").otherwise(F.substring(key, 1, EDGE_KEY[1]))


def repeated_at_edges(lines: DataFrame, pages: DataFrame, repeats: int = EDGE_PAGES, share: float = EDGE_SHARE) -> DataFrame:
    """doc_id, key of lines at the head or foot of so many pages, at least that share of a document's (pages: doc_id, page, height)."""
    rows = lines.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"])
    rows = rows.where((F.col("top") < EDGE_ZONES[0] * F.col("height")) | (F.col("bottom") > EDGE_ZONES[1] * F.col("height")))
    counts = rows.select("doc_id", "page", header_footer_key(F.col("text")).alias("key")).where("key != ''").groupBy("doc_id", "key").agg(F.count_distinct("page").alias("n"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return counts.join(total, "doc_id").where(F.col("n") >= F.greatest(F.lit(repeats), F.ceil(share * F.col("pages")))).select("doc_id", "key")


def body_lines(lines: DataFrame, tables: DataFrame, pages: DataFrame, share: float = TABLE_OVERLAP) -> DataFrame:
    """Lines that are no page number, repeat at no edge, stand in no margin and in no table of their page."""
    rows = lines.join(pages.select("doc_id", "page", F.col("width").alias("w__"), F.col("height").alias("h__")), ["doc_id", "page"])
    rows = rows.where(~is_page_number(F.col("text")) & ~in_margin(F.col("w__"), F.col("h__"))).withColumn("key", header_footer_key(F.col("text")))
    rows = rows.join(repeated_at_edges(lines, pages), ["doc_id", "key"], "left_anti").select(*lines.columns)
    return outside_regions(rows, tables, share)


def looks_like_heading(text: Column, font_size: Column) -> Column:
    t = T.strip(text)
    return ((F.length(t) <= HEADING_CHARS) & t.rlike(HEADING)) | ((F.length(t) <= PLAIN_HEADING_CHARS) & ~t.rlike(NO_HEADING) & (font_size >= PLAIN_HEADING_FONT))


def looks_like_caption(text: Column) -> Column:
    return T.strip(text).rlike(CAPTION)


def looks_like_figure_caption(text: Column) -> Column:
    return T.strip(text).rlike(FIGURE_CAPTION)


def looks_like_source(text: Column) -> Column:
    return T.strip(text).rlike(SOURCE)


def looks_like_table_title(text: Column) -> Column:
    """Titles of tables that have no caption."""
    return T.strip(text).rlike(UNCAPTIONED)


def is_numeric_fragment(text: Column) -> Column:
    return T.strip(text).rlike(NUMERIC)


def ends_sentence(text: Column) -> Column:
    return T.strip(text).rlike(r"[。！？!?]$")


def starts_item(text: Column) -> Column:
    return T.strip(text).rlike(rf"^{BULLET}")


def paragraphs(lines: DataFrame, gap: float = GAP) -> DataFrame:
    """doc_id, page, col_id, para, top, bottom, text: lines of a column joined until a gap, another band, a heading, a caption, a source, a list or an indent.

    lines: doc_id, page, ord, col_id, x0, top, x1, bottom, text and font_size (0 where
    there is none). Depends on the previous line only, so breaks are marked by lag and
    numbered by a running sum.
    """
    column = Window.partitionBy("doc_id", "page", "col_id")
    w = column.orderBy("top", "x0", "ord")
    height = F.coalesce(F.percentile(F.when(F.col("bottom") > F.col("top"), F.col("bottom") - F.col("top")), 0.5).over(column), F.lit(LINE_HEIGHT))
    font = F.coalesce("font_size", F.lit(0.0)) if "font_size" in lines.columns else F.lit(0.0)
    lag = lambda c: F.lag(c).over(w)
    rows = lines.withColumns({"h__": height, "f__": font})
    rows = rows.withColumns({f"p_{c}": lag(c) for c in ("x0", "top", "x1", "bottom", "text", "f__")})
    band = overlap_ratio(F.col("p_x0"), F.col("p_x1"), F.col("x0"), F.col("x1")) >= SAME_BAND
    space, h = F.col("top") - F.col("p_bottom"), F.col("h__")
    aside = ~band & (F.abs(F.col("top") - F.col("p_top")) < DETACHED_ROW * h) & (F.abs(F.col("x0") + F.col("x1") - F.col("p_x0") - F.col("p_x1")) / 2 > DETACHED_SIDE * h)
    marked = lambda t, f: looks_like_heading(t, f) | looks_like_caption(t) | looks_like_source(t)
    listed = starts_item(F.col("text")) & ~starts_item(F.col("p_text"))
    indented = (F.col("x0") - F.col("p_x0") > INDENT * h) & ends_sentence(F.col("p_text"))
    breaks = (
        F.col("p_text").isNull() | (space > gap * h) | aside | (~band & (space > GAP_APART * h))
        | marked(F.col("text"), F.col("f__")) | marked(F.col("p_text"), F.col("p_f__")) | listed | indented
    )
    rows = rows.withColumn("para", F.sum(breaks.cast("int")).over(w))
    parts = rows.groupBy("doc_id", "page", "col_id", "para").agg(
        F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.array_sort(F.collect_list(F.struct("top", "x0", "ord", "text"))).alias("parts")
    )
    out = parts.select("doc_id", "page", "col_id", F.col("para").cast("long").alias("para"), "top", "bottom", join_lines(F.transform("parts", lambda p: p["text"])).alias("text"))
    return out.where("text != ''")


def one_line(text: Column) -> Column:
    """White space, newlines too, as single blanks, none between ideographs."""
    return F.regexp_replace(T.compact(F.translate(text, "　", " ")), r"(?<=[一-鿿]) (?=[一-鿿])", "")


def joins_without_space(left: Column, right: Column) -> Column:
    """Between ideographs, and after a hyphen, which stays."""
    return (left.rlike("[一-鿿]$") & right.rlike("^[一-鿿]")) | (left.endswith("-") & right.rlike("^[A-Za-z]"))


def join_lines(lines: Column) -> Column:
    """Lines as one text; missing and empty ones are left out."""
    step = lambda text, line: F.when(text == "", line).when(joins_without_space(text, line), F.concat(F.rtrim(text), F.ltrim(line))).otherwise(F.concat(text, F.lit(" "), line))
    given = F.filter(F.transform(lines, lambda x: F.coalesce(x, F.lit(""))), lambda x: T.strip(x) != "")
    return one_line(F.aggregate(given, F.lit(""), step))


def visual_rows(lines: DataFrame) -> DataFrame:
    """Adds ``row_no`` (from 0) on each page: a line is of the row before it if its top is close to the mean top of that row's lines.

    The mean moves with every line, so rows are a fold over a page's lines in order; a
    page holds some hundred.
    """
    item = F.struct("top", "x0", "ord", (F.col("bottom") - F.col("top")).alias("height"))
    pages = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.struct(F.lit(-1).alias("row_no"), F.lit(0.0).alias("tops"), F.lit(0.0).alias("heights"), F.lit(0).alias("n"), F.array().cast("array<struct<ord:int,row_no:int>>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        n = F.greatest(s["n"], F.lit(1))
        same = (s["n"] > 0) & (F.abs(x["top"] - s["tops"] / n) <= ROW_SHARE * F.greatest(F.lit(ROW_HEIGHT), s["heights"] / n))
        number = F.when(same, s["row_no"]).otherwise(s["row_no"] + 1)
        add = lambda old, new: F.when(same, old + new).otherwise(new)
        return F.struct(
            number.alias("row_no"), add(s["tops"], x["top"].cast("double")).alias("tops"), add(s["heights"], x["height"].cast("double")).alias("heights"), add(s["n"], F.lit(1)).alias("n"),
            F.concat(s["done"], F.array(F.struct(x["ord"].cast("int").alias("ord"), number.alias("row_no")))).alias("done"),
        )

    placed = pages.select("doc_id", "page", F.inline(F.aggregate("items", empty, step)["done"]))
    return lines.join(placed, ["doc_id", "page", "ord"])


def columns_of_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds is_full_width and col_id (0 or 1): pages of enough lines part at the widest gap of left edges, else of centres."""
    rows = lines.join(pages.select("doc_id", "page", F.col("width").alias("w__")), ["doc_id", "page"]).withColumn("c__", (F.col("x0") + F.col("x1")) / 2)
    width, wide = F.col("w__"), F.col("x1") - F.col("x0")
    body = rows.where((wide >= BODY_WIDTH) & (wide < BODY_SHARE * width))

    def gaps(by: str) -> DataFrame:
        w = Window.partitionBy("doc_id", "page").orderBy(by, "ord")
        every = Window.partitionBy("doc_id", "page")
        out = body.withColumns({"next": F.lead(by).over(w), "n": F.row_number().over(w), "total": F.count("*").over(every)})
        return out.withColumns({"gap": F.col("next") - F.col(by), "at": (F.col("next") + F.col(by)) / 2, "sided": (F.col("n") >= SPLIT_SIDE) & (F.col("total") - F.col("n") >= SPLIT_SIDE)})

    page = ["doc_id", "page"]
    able = F.col("sided") & (F.col("gap") >= SPLIT_GAP * width) & F.col("at").between(SPLIT_WITHIN[0] * width, SPLIT_WITHIN[1] * width)
    left = gaps("x0").groupBy(*page).agg(F.max(F.when(able, F.struct("gap", "n", "at"))).alias("a"), F.first("total").alias("total"), (F.max("x0") - F.min("x0")).alias("spread"), F.first("w__").alias("pw"))
    centre = gaps("c__").where("gap IS NOT NULL").groupBy(*page).agg(F.max(F.struct("gap", "n", "at", "sided")).alias("b"))
    within = F.col("b.at").between(SPLIT_CENTRE_WITHIN[0] * F.col("pw"), SPLIT_CENTRE_WITHIN[1] * F.col("pw"))
    other = F.when((F.col("spread") >= SPLIT_SPREAD * F.col("pw")) & F.col("b.sided") & (F.col("b.gap") >= SPLIT_CENTRE_GAP * F.col("pw")) & within, F.col("b.at"))
    splits = left.join(centre, page, "left").select(*page, F.when(F.col("total") >= SPLIT_LINES, F.coalesce("a.at", other)).alias("split__"))
    rows = rows.join(splits, page, "left").withColumn("is_full_width", wide >= FULL_WIDTH * width)
    right = F.col("split__").isNotNull() & ~F.col("is_full_width") & (F.col("c__") >= F.col("split__"))
    return rows.withColumn("col_id", right.cast("int")).drop("w__", "c__", "split__")


def is_table(rows: Column, wide: Column, high: Column, page_width: Column, page_height: Column) -> Column:
    """Whether rows of cells in a box of that size are a table and not a layout."""
    cells = F.transform(F.flatten(rows), T.strip)
    lengths = F.transform(cells, lambda c: F.length(c))
    most = lambda x: F.coalesce(F.array_max(x), F.lit(0))
    n_rows, longest = F.size(rows), most(lengths)
    grid = (n_rows >= LEAST_ROWS) & (most(F.transform(rows, lambda r: F.size(r))) >= LEAST_COLUMNS)
    filled = (F.size(F.filter(lengths, lambda n: n > 0)) >= LEAST_FILLED) & (F.aggregate(lengths, F.lit(0), lambda s, n: s + n) >= LEAST_CHARS)
    sized = (wide >= F.greatest(F.lit(LEAST_WIDTH), LEAST_WIDTH_SHARE * page_width)) & (high >= LEAST_HEIGHT)
    column = (high > COLUMN_HEIGHT * page_height) & (wide < COLUMN_WIDTH * page_width)
    whole_page = (wide > PAGE_WIDTH * page_width) & (high > PAGE_HEIGHT * page_height) & ((n_rows < PAGE_ROWS) | (longest > PAGE_CELL))
    prose = (longest > PROSE_CELL) & (n_rows < PROSE_ROWS)
    return grid & filled & sized & ~column & ~whole_page & ~prose


def inside(x: Column, y: Column) -> Column:
    """Whether a point is in the box of columns x0, top, x1, bottom."""
    return x.between(F.col("x0"), F.col("x1")) & y.between(F.col("top"), F.col("bottom"))


def without_position_tags(text: Column) -> Column:
    return F.regexp_replace(text, POSITION_TAG, "")


def block_type(layout: Column) -> Column:
    """A layout label as a block's type: text where nothing else is said."""
    low = F.lower(F.coalesce(layout, F.lit("")))
    return F.when(low.contains("table"), "table").when(low.contains("figure") | low.contains("image"), "figure").when(low.contains("title"), "title").otherwise("text")


def box_of_positions(positions: Column) -> Column:
    """struct<page, x0, top, x1, bottom>: the union of positions array<array<double>> (page, x0, x1, top, bottom) on their first page; null without any."""
    page = F.array_min(F.transform(positions, lambda p: F.get(p, 0)))
    on = F.filter(positions, lambda p: F.get(p, 0) == page)
    side = lambda k, best: best(F.transform(on, lambda p: F.get(p, k)))
    return F.when(F.size(positions) > 0, F.struct(page.cast("int").alias("page"), side(1, F.array_min).alias("x0"), side(3, F.array_min).alias("top"), side(2, F.array_max).alias("x1"), side(4, F.array_max).alias("bottom")))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds ``place``: full-width blocks part a page into bands; in a band by column, then top, then left."""
    w = Window.partitionBy("doc_id", "page").orderBy("top", "x0", "block_id")
    rows = blocks.withColumn("wide", F.col("is_full_width").cast("int")).withColumn("band", 2 * F.sum("wide").over(w) - F.col("wide"))
    order = Window.partitionBy("doc_id", "page").orderBy("band", F.when(F.col("is_full_width"), 0).otherwise(F.col("col_id")), "top", "x0", "block_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).drop("wide", "band")


def merge_layout(blocks: DataFrame) -> DataFrame:
    """One block per (doc_id, page, type, layoutno): the union of boxes, the texts from top to bottom, and what else the parts carry.

    Optional columns: positions (array of page, x0, x1, top, bottom) are those of all
    parts in order, col_id gives col_ids, each once; block_id gives source_block_ids.
    """
    part = F.struct("top", "x0", "ord", "text", *(c for c in ("positions", "block_id") if c in blocks.columns))
    rows = blocks.groupBy("doc_id", "page", "type", "layoutno").agg(
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.array_sort(F.collect_list(part)).alias("parts"),
        *([F.array_sort(F.collect_set("col_id")).alias("col_ids")] if "col_id" in blocks.columns else []),
    )
    each = lambda name: F.transform("parts", lambda p: p[name])
    more = [F.flatten(F.filter(each("positions"), lambda p: p.isNotNull())).alias("positions")] if "positions" in blocks.columns else []
    more += [each("block_id").alias("source_block_ids")] if "block_id" in blocks.columns else []
    more += ["col_ids"] if "col_id" in blocks.columns else []
    return rows.select("doc_id", "page", "type", "layoutno", "x0", "top", "x1", "bottom", join_lines(each("text")).alias("text"), *more)


def continues_across_pages(blocks: DataFrame, height: str = "height") -> DataFrame:
    """Adds ``joined``: the number of a text that goes on from the foot of one page to the head of the next; a join is measured from the text's first block's box."""
    w = Window.partitionBy("doc_id").orderBy("page", "ord")
    lag = lambda c: F.lag(c).over(w)
    # a joined text keeps the page and the box of its first block, so it is never joined twice
    able = (
        (F.col("type") == "text") & (lag("type") == "text") & (F.col("page") == lag("page") + 1) & (lag("bottom") >= CONTINUES_BELOW * lag(height)) & (F.col("top") <= CONTINUES_ABOVE * F.col(height))
        & (F.abs(lag("x0") - F.col("x0")) <= CONTINUES_SHIFT) & ~T.strip("text").rlike(NEW_SECTION) & ~looks_like_source(lag("text")) & ~looks_like_source(F.col("text"))
    )
    rows = blocks.withColumn("able__", F.coalesce(able, F.lit(False)))
    # of able blocks in a row every other one joins: what follows a joined block does not
    run = Window.partitionBy("doc_id").orderBy("page", "ord")
    rows = rows.withColumn("island__", F.sum((~F.col("able__")).cast("int")).over(run))
    rows = rows.withColumn("place__", F.row_number().over(Window.partitionBy("doc_id", "island__").orderBy("page", "ord")))
    goes_on = F.col("able__") & (F.col("place__") % 2 == 0)
    return rows.withColumn("joined", F.sum(F.when(goes_on, 0).otherwise(1)).over(w).cast("long")).drop("able__", "island__", "place__")


def joined_texts(blocks: DataFrame, height: str = "height") -> DataFrame:
    """doc_id, joined, page, text, block_ids of ``continues_across_pages``: texts that go on are one."""
    rows = continues_across_pages(blocks, height).groupBy("doc_id", "joined").agg(F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("ord", "block_id", "text"))).alias("parts"))
    glue = lambda a, b: F.when(a == "", b).when(b == "", a).when(joins_without_space(a, b), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))
    text = F.aggregate(F.transform("parts", lambda p: T.strip(p["text"])), F.lit(""), glue)
    return rows.select("doc_id", "joined", "page", text.alias("text"), F.transform("parts", lambda p: p["block_id"]).alias("block_ids"))


def within_budget(texts: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The nearest texts while their characters fit ``most``; the first always does."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = texts.withColumn("sum__", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n__", F.row_number().over(w))
    return rows.where((F.col("sum__") <= most) | (F.col("n__") == 1)).drop("sum__", "n__")


def file_fields(name: Column) -> Column:
    """struct<date, company, institution, title, rating> of a report's file name: its parts between underscores, after the one that is a date."""
    from quillspark.operators.cascade import is_broker_name, is_company_token

    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?i)\.pdf$", ""), r"\.parsed(\.json)?", "")
    parts = F.split(stem, "_")
    dated = F.array_position(F.transform(parts, lambda p: p.rlike(r"^\d{4}-\d{2}-\d{2}$")), True)
    tail = F.when(dated > 0, F.slice(parts, (dated + 1).cast("int"), F.size(parts))).otherwise(F.array().cast("array<string>"))
    first, second, n = F.get(tail, 0), F.get(tail, 1), F.size(tail)
    rest = lambda k: F.array_join(F.slice(tail, k, F.greatest(n, F.lit(1))), " ")
    is_company = F.coalesce(is_company_token(first), F.lit(False))
    broker = F.get(F.filter(F.slice(tail, 2, F.greatest(n, F.lit(1))), is_broker_name), 0)
    after_broker = F.when(broker.isNotNull(), F.array_join(F.slice(tail, (F.array_position(tail, broker) + 1).cast("int"), F.greatest(n, F.lit(1))), " ")).when(n > 1, rest(2)).otherwise(rest(1))
    pick = lambda both, only_broker, company, other: (
        F.when(n == 0, "").when(is_company & F.coalesce(is_broker_name(second), F.lit(False)), both).when(is_broker_name(first), only_broker).when(is_company, company).otherwise(other)
    )
    company = pick(company_name(first), F.lit(""), company_name(first), F.lit(""))
    institution = pick(second, first, F.coalesce(broker, F.lit("")), first)
    title = pick(rest(3), rest(2), after_broker, rest(2))
    return F.struct(
        F.when(dated > 0, F.get(parts, (dated - 1).cast("int"))).otherwise("").alias("date"),
        T.clean_text(company).alias("company"), T.clean_text(institution).alias("institution"), T.clean_text(title).alias("title"), F.regexp_extract(stem, RATING, 1).alias("rating"),
    )


def company_name(token: Column) -> Column:
    """A name and its code as name（code.exchange）."""
    t = T.clean_text(token)
    name, code = T.clean_text(F.regexp_extract(t, r"^(.*?)([A-Za-z]?\d{5,6})$", 1)), F.regexp_extract(t, r"^(.*?)([A-Za-z]?\d{5,6})$", 2)
    full = F.concat(code, F.lit("."), stock_suffix(code))
    return F.when(code == "", t).when(name != "", F.concat(name, F.lit("（"), full, F.lit("）"))).otherwise(full)


def stock_suffix(code: Column) -> Column:
    """The exchange that a code's first digits belong to; Shanghai where none tells."""
    digits = F.regexp_replace(code, r"\D", "")
    out = None
    for suffix, starts in STOCK_SUFFIXES:
        hit = F.substring(digits, 1, 3).isin(*starts)
        out = F.when(hit, suffix) if out is None else out.when(hit, suffix)
    return out.otherwise("SH")


def cover_view(sentences: DataFrame, is_noise: Column, least: int = 20) -> DataFrame:
    """doc_id, view: the first sentence of a document's first page that is long enough and no noise (columns doc_id, ord, text)."""
    rows = sentences.where(~is_noise & (F.length(T.clean_text("text")) >= least))
    return rows.groupBy("doc_id").agg(F.min_by(T.clean_text("text"), "ord").alias("view"))
