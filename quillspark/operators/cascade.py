"""The ordered rules that decide which blocks of a parsed report are kept: contents pages, covers, noise, and the regions that titles open.

Blocks: doc_id, ord, block_id, page, type (title, text, table, figure), x0, top, x1,
bottom, text. Pages: doc_id, page, width, height. The rules look like a loop with state,
but the state before a block only depends on the last markers before it, so all of it is
windows over a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators.blocks import EDGE_BOTTOM, EDGE_LENGTH, EDGE_REPEATS, EDGE_TOP
from quillspark.operators.layout import COVER_CHARS, COVER_SIDE, COVER_SIDE_BOTTOM, COVER_TOP, PAGE, follows_in_column

# The words, patterns and limits that results depend on, in the order of the rules.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
RATING = r"优于大市|强于大市|买入|增持|中性|持有|减持|卖出|弱于大市"
ANALYST = rf"证券分析师|分析师|S\d{{15,}}|@[\w.-]+|{EMAIL}"
CONTACT = rf"证券分析师|分析师|S\d{{15,}}|执业编号|邮箱|电话|传真|联系电话|微信|@[\w.-]+|{EMAIL}"
CONTACT_SURE = r"S\d{13,15}|SAC登记编号|登记编号|执业编号|邮箱|@"
CONTACT_PHONE, PHONE_NUMBER = r"电话|传真|联系电话|微信", r"\+?\d[\d\-() ]{5,}\d"
CONTACT_FIRST, CONTACT_CHARS, CONTACT_SHORT = ("分析师", "联系人"), 160, 64
RELATED_REPORT = r"相关研究报告|往期研究|历史报告"
RISK = r"风险提示|风险因素|风险分析"
SKIP_SECTION = r"分析师介绍|要求披露|公司简介|研究所|中山证券研究所|联系人|证券分析师|证券研究报告"
TERMINAL_TITLES = (
    "免责声明", "特别声明", "一般声明", "重要声明", "法律声明", "分析师声明", "证券分析师声明", "信息披露声明", "投资评级说明", "投资评级的说明", "评级说明", "风险提示及免责声明",
)
SOURCE_LINE, SOURCE_CHARS = r"^资料来源[:：]", 48
NOISY_TITLES, NOISY_TITLE = ("研究所", "北京", "上海", "深圳", "联系人"), r"(?i)table_|投tab|乱码|[\[\]@#]{2,}"
NOISE_TEXTS = ("中山证券研究所", "中邮证券研究所", "国金证券研究所", "研究所", "北京", "上海", "深圳")
NOISE_END, NOISE_CHARS, NOISE_END_CHARS = r"(证券研究报告|行业周报|行业点评报告|研究所)$", 20, 40
CONTENTS = "目录"
CONTENTS_TITLES = ("内容目录", "图表目录")
FIGURE_WORDS = r"图\d+|走势|趋势|同比|环比|增长|下降|占比|变化|月度|累计|价格指数|发电量|用电量"
FIGURE_NOISE, FIGURE_CHARS = r"^[\d\s\.\-%/%+(),:：A-Za-z]{1,30}$", 18
TREND_WORDS = r"同比|环比|增长|下降|占比|走势|趋势|变化"
BROKER = "证券"
CJK = r"[一-鿿]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _lines(text: Column) -> Column:
    """The lines that are not blank, cleaned."""
    return F.filter(F.transform(F.split(text, "\n"), T.clean_text), lambda x: x != "")


def is_analyst_contact(text: Column) -> Column:
    t = T.clean_text(text)
    phone = t.rlike(CONTACT_PHONE) & t.rlike(PHONE_NUMBER)
    first = (t.startswith(CONTACT_FIRST[0]) | t.startswith(CONTACT_FIRST[1])) & (F.length(t) <= CONTACT_SHORT)
    return (t != "") & (F.length(t) <= CONTACT_CHARS) & t.rlike(CONTACT) & (t.rlike(CONTACT_SURE) | phone | first)


def is_noisy_cover(text: Column) -> Column:
    """Mostly Latin letters and digits, as from a logo or an address."""
    t = T.clean_text(text)
    latin = F.aggregate(F.regexp_extract_all(t, F.lit("([A-Za-z0-9]{2,})"), F.lit(1)), F.lit(0), lambda s, x: s + F.length(x))
    mostly = (latin > 0) & (latin / F.greatest(F.length(t), F.lit(1)) > 0.55) & (_count(t, CJK) <= 6)
    return (F.length(t) >= 8) & (mostly | ((_count(t, "[A-Za-z]{2,}") >= 4) & (_count(t, CJK) <= 4)))


def is_broker_name(text: Column) -> Column:
    return T.clean_text(text).contains(BROKER)


def is_company_token(text: Column) -> Column:
    """A name that ends in a stock code."""
    t = T.clean_text(text)
    return (t != "") & ~is_broker_name(text) & t.rlike(r"([A-Za-z]?\d{6}|\d{5,6})$") & t.rlike("[一-鿿A-Za-z]")


def is_noisy_title(text: Column) -> Column:
    t = T.clean_text(text)
    return t.rlike(SKIP_SECTION) | t.isin(*NOISY_TITLES) | t.rlike(NOISY_TITLE) | (is_noisy_cover(text) & (_count(t, CJK) <= 6)) | (F.length(t) <= 2)


def is_terminal_title(text: Column) -> Column:
    return F.regexp_replace(T.clean_text(text), "^[：:;；]+|[：:;；]+$", "").isin(*TERMINAL_TITLES)


def is_noise_text(text: Column) -> Column:
    t = T.clean_text(text)
    return (t == "") | ((F.length(t) <= NOISE_CHARS) & t.isin(*NOISE_TEXTS)) | ((F.length(t) <= NOISE_END_CHARS) & t.rlike(NOISE_END))


def is_contents(text: Column) -> Column:
    """Lines of a table of contents: dotted page numbers, or several numbered headings with pages."""
    t = T.clean_text(text)
    short = _count(t, r"\d{1,2}")
    return (t != "") & (
        t.contains(CONTENTS)
        | t.rlike(r"^[\d\s.．·…-]{1,16}$")
        | ((_count(t, r"\d+") >= 6) & t.rlike(r"[.．·…]{2,}"))
        | ((_count(t, "[一二三四五六七八九十]、") >= 3) & (short >= 3))
        | ((_count(t, r"[（(][一二三四五六七八九十\d]+[）)]") >= 3) & (short >= 4))
        | ((_count(t, r"[一二三四五六七八九十]+、|[（(][一二三四五六七八九十\d]+[）)]") >= 4) & (short >= 3))
    )


def is_source_only(text: Column) -> Column:
    """One short line, or lines that all name a source."""
    lines = _lines(text)
    one = (F.size(lines) == 1) & (F.length(F.get(lines, 0)) <= SOURCE_CHARS)
    return (F.size(lines) > 0) & (one | F.forall(lines, lambda x: x.rlike(SOURCE_LINE)))


def _useful_lines(text: Column) -> Column:
    return F.filter(_lines(text), lambda x: ~x.rlike(SOURCE_LINE) & ~(x.rlike(FIGURE_NOISE) & ~x.rlike(FIGURE_WORDS)))


def is_meaningful_figure(text: Column) -> Column:
    t = T.clean_text(text)
    return (t != "") & t.rlike(FIGURE_WORDS) & (F.length(F.array_join(_useful_lines(t), " ")) >= FIGURE_CHARS)


def figure_title(text: Column) -> Column:
    """The first line that numbers a figure, else the first line."""
    lines = _lines(text)
    return F.coalesce(F.get(F.filter(lines, lambda x: x.rlike(r"图\d+")), 0), F.get(lines, 0), F.lit(""))


def figure_trend(text: Column) -> Column:
    """The first two useful lines on a trend."""
    return F.array_join(F.slice(F.filter(_useful_lines(text), lambda x: x.rlike(TREND_WORDS)), 1, 2), " ")


def normalised_blocks(raw: DataFrame) -> DataFrame:
    """Blocks of (doc_id, ord, id, type, page, bbox, text) in any types, with defaults for what is missing or can't be read."""
    side = lambda k: F.coalesce(F.try_element_at(F.col("bbox").cast("array<double>"), F.lit(k)), F.lit(0.0))
    return raw.select(
        "doc_id", "ord", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("block_id"), F.coalesce(F.col("page").try_cast("int"), F.lit(0)).alias("page"),
        F.coalesce(F.col("type").cast("string"), F.lit("text")).alias("type"), side(1).alias("x0"), side(2).alias("top"), side(3).alias("x1"), side(4).alias("bottom"),
        T.clean_text(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )


def contents_pages(blocks: DataFrame) -> DataFrame:
    """doc_id, page of tables of contents: pages with such a title, and those after the last of them, up to a page with a title or with text that is none.

    Pages without text neither end the table nor belong to it.
    """
    title, text = F.col("type") == "title", F.col("type") == "text"
    t = F.col("text")
    named = title & (t.contains(CONTENTS_TITLES[0]) | t.contains(CONTENTS_TITLES[1]) | (T.strip(t) == CONTENTS))
    pages = blocks.groupBy("doc_id", "page").agg(
        F.bool_or(named).alias("seed"), F.bool_or(title).alias("titled"), F.bool_or(text).alias("worded"), F.coalesce(F.bool_and(F.when(text, is_contents(t))), F.lit(True)).alias("listed")
    )
    doc = Window.partitionBy("doc_id")
    rows = pages.withColumn("last", F.max(F.when(F.col("seed"), F.col("page"))).over(doc))
    after = F.col("page") > F.col("last")
    rows = rows.withColumn("stop", F.min(F.when(after & (F.col("titled") | ~F.col("listed")), F.col("page"))).over(doc))
    goes_on = after & F.col("worded") & (F.col("stop").isNull() | (F.col("page") < F.col("stop")))
    return rows.where(F.col("seed") | F.coalesce(goes_on, F.lit(False))).select("doc_id", "page")


def classified_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``is_cover`` and ``reason`` (null: the block is kept); a page without a size has the usual one."""
    t, kind = F.col("text"), F.col("type")
    title, text = kind == "title", kind == "text"
    contents = contents_pages(blocks).withColumn("contents__", F.lit(True))
    rows = blocks.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"], "left").join(contents, ["doc_id", "page"], "left")
    width, height = F.coalesce("width", F.lit(PAGE[0])), F.coalesce("height", F.lit(PAGE[1]))
    header_like = title | t.rlike(RATING) | t.rlike(ANALYST)
    banner = (F.col("top") <= COVER_TOP * height) & (title | (F.length(t) <= COVER_CHARS))
    sidebar = (F.col("x0") >= COVER_SIDE * width) & (F.col("bottom") <= COVER_SIDE_BOTTOM * height) & header_like
    edge = (F.col("top") <= EDGE_TOP * height) | (F.col("bottom") >= EDGE_BOTTOM * height)
    key = F.when(edge, T.edge_key(t))
    rows = rows.withColumns({
        "width__": width, "is_cover": (F.col("page") == 1) & (banner | sidebar), "contents__": F.coalesce("contents__", F.lit(False)),
        "edge__": F.when((F.length(key) > 0) & (F.length(key) <= EDGE_LENGTH), key),
    })
    # counted, then joined: a document's repeated lines are one row each
    repeated = rows.where("edge__ IS NOT NULL").groupBy("doc_id", "edge__").agg(F.count("*").alias("n")).where(F.col("n") >= EDGE_REPEATS).drop("n").withColumn("repeated__", F.lit(True))
    rows = rows.join(repeated, ["doc_id", "edge__"], "left")
    plain = (t != "") & ~F.col("contents__") & F.col("repeated__").isNull()  # no rule has matched yet
    related, terminal = title & t.rlike(RELATED_REPORT), title & is_terminal_title(t)
    risk = text & t.rlike(RISK) & ~F.col("contents__")
    # a risk text whose own rule is the contents one does not end a region
    reached = plain & ~is_analyst_contact(t) & ~is_noise_text(t)
    rows = rows.withColumns({"related__": plain & related, "terminal__": plain & terminal & ~related, "title__": title & ~related & ~terminal & ~t.rlike(SKIP_SECTION), "risk__": risk})
    place = lambda name: F.struct(F.lit(name).alias("kind"), *(F.col(c) for c in ("ord", "block_id", "page", "x0", "x1", "bottom")))

    def judged(rows: DataFrame, risk: Column) -> DataFrame:
        """With the state before each block: the last marker that sets it, and whether a title has ended a list of reports since."""
        before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        marker = F.when(F.col("related__"), place("related")).when(F.col("terminal__"), place("terminal")).when(risk, place("none"))
        return rows.withColumn("m__", F.last(marker, True).over(before)).withColumn("n__", F.last(F.when(F.col("title__"), F.col("ord")), True).over(before))

    sides = ("page", "x0", "x1", "bottom")
    m = {c: F.col(f"m__.{c}") for c in sides}
    follows = (F.col("block_id") != F.col("m__.block_id")) & follows_in_column({c: F.col(c) for c in ("page", "x0", "x1", "top")}, m, F.col("width__"))
    in_related = (F.col("m__.kind") == "related") & (F.col("n__").isNull() | (F.col("n__") < F.col("m__.ord")))
    in_terminal = F.col("m__.kind") == "terminal"

    def reason(risk: Column) -> Column:
        rule = (
            F.when(t == "", "empty")
            .when(F.col("contents__"), "table_of_contents_page")
            .when(F.col("repeated__"), "header_or_footer")
            .when(text & is_analyst_contact(t), "analyst_info")
            .when(text & is_noise_text(t), "text_noise")
            .when(F.col("related__"), "related_report_title")
            .when(F.col("terminal__"), "terminal_section_title")
            .when(title & is_noisy_title(t), "title_noise")
            .when(in_related & follows & (title | text) & ~t.rlike(RISK), "related_report_block")
            .when(in_terminal & ((F.col("page") >= m["page"]) | follows) & kind.isin("text", "title", "table", "figure"), "terminal_section_block")
            .when(t.rlike(SOURCE_LINE) & is_source_only(t), "source_only")
            .when(text & is_contents(t), "table_of_contents_noise")
            .when((kind == "figure") & ~is_meaningful_figure(t), "low_quality_figure_ocr")
        )
        kept = F.when(risk, F.lit(None)).otherwise(rule)
        return F.when(F.col("is_cover") & is_analyst_contact(t), "analyst_info").otherwise(kept)

    # whether a risk text that reads like contents ends a region hangs on the region it stands in
    listed = text & is_contents(t) & reached & ~(t.rlike(SOURCE_LINE) & is_source_only(t))
    first = judged(rows, F.col("risk__"))
    sure = F.col("risk__") & ~(listed & ~F.coalesce(in_terminal & ((F.col("page") >= m["page"]) | follows), F.lit(False)))
    rows = judged(first.withColumn("risk__", sure).drop("m__", "n__"), F.col("risk__"))
    out = rows.withColumn("reason", reason(F.col("risk__")))
    return out.select(*blocks.columns, "is_cover", "reason")


def removed_blocks(classified: DataFrame, chars: int = 180) -> DataFrame:
    """doc_id, block_id, page, type, reason, text: what was dropped and why, texts cut to ``chars``."""
    return classified.where("reason IS NOT NULL").select("doc_id", "block_id", "page", "type", "reason", F.substring("text", 1, chars).alias("text"))
