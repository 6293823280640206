import re

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import blocks as B, cascade, chunking, layout


def blocks(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, page int, ord int, block_id string, type string, x0 double, top double, x1 double, bottom double, text string")


def test_cover_and_contents(spark):
    df = blocks(spark, [(1, 1, 0, "a", "title", 0.0, 10.0, 100.0, 30.0, "T"), (1, 1, 1, "b", "text", 400.0, 200.0, 500.0, 300.0, "side"), (1, 1, 2, "c", "text", 0.0, 500.0, 100.0, 520.0, "body"),
                        (1, 2, 3, "d", "title", 0.0, 0.0, 1.0, 1.0, "目录"), (1, 3, 4, "e", "text", 0.0, 0.0, 1.0, 1.0, "1 ... 2"), (1, 5, 5, "f", "text", 0.0, 0.0, 1.0, 1.0, "plain"), (1, 6, 6, "g", "text", 0.0, 0.0, 1.0, 1.0, "3 ... 4")])
    pages = spark.createDataFrame([(1, 1, 595.0, 842.0)], "doc_id int, page int, width double, height double")
    assert sorted(r.block_id for r in layout.cover_blocks(df, pages).collect()) == ["a", "b"]
    # page 3 goes on, page 4 is missing, page 5 ends it; page 6 is no part although it reads like one
    assert sorted(r.page for r in cascade.contents_pages(df).collect()) == [2, 3]
    more = df.where("page != 3").unionByName(blocks(spark, [(1, 3, 4, "e", "text", 0.0, 0.0, 1.0, 1.0, "1 甲 .... 2 3 乙 .... 4 5 丙 .... 6"), (1, 4, 9, "h", "figure", 0.0, 0.0, 1.0, 1.0, "图")]))
    assert sorted(r.page for r in cascade.contents_pages(more).collect()) == [2, 3]


def test_regions(spark):
    lines = blocks(spark, [(1, 1, 0, "a", "text", 0.0, 0.0, 10.0, 10.0, "in"), (1, 1, 1, "b", "text", 0.0, 50.0, 10.0, 60.0, "out"), (1, 2, 2, "c", "text", 0.0, 0.0, 10.0, 10.0, "other page")])
    table = lines.where("ord = 0")
    assert sorted(r.block_id for r in layout.outside_regions(lines, table, 0.18).collect()) == ["b", "c"]
    assert layout.merge_visual_tables(lines, table).count() == 3


def test_paragraphs_and_order(spark):
    rows = [(1, 1, k, 0, 0.0, float(12 * k), 100.0, float(12 * k + 10), t) for k, t in enumerate(("first line", "of a para-", "graph.", "• item"))] + [(1, 1, 4, 0, 0.0, 200.0, 100.0, 210.0, "after a gap")]
    lines = spark.createDataFrame(rows, "doc_id int, page int, ord int, col_id int, x0 double, top double, x1 double, bottom double, text string")
    assert [r.text for r in layout.paragraphs(lines).orderBy("para").collect()] == ["first line of a para-graph.", "• item", "after a gap"]
    cells = [("w1", True, 0, 0.0), ("l1", False, 0, 10.0), ("r1", False, 1, 10.0), ("l2", False, 0, 20.0), ("w2", True, 0, 30.0), ("l3", False, 0, 40.0)]
    df = spark.createDataFrame([(1, 1, b, w, c, 0.0 if c == 0 else 300.0, t) for b, w, c, t in cells], "doc_id int, page int, block_id string, is_full_width boolean, col_id int, x0 double, top double")
    assert [r.block_id for r in layout.reading_order(df).orderBy("place").collect()] == ["w1", "l1", "l2", "r1", "w2", "l3"]


def test_text_helpers(spark):
    row = spark.range(1).select(layout.join_lines(F.array(F.lit("中文"), F.lit("字"), F.lit("ab"), F.lit(None))).alias("j"), layout.stock_suffix(F.lit("600519")).alias("a"), layout.stock_suffix(F.lit("300750")).alias("b"),
                                layout.file_fields(F.lit("12_2024-05-06_某公司600519_券商.pdf")).alias("f")).first()
    assert row.j == "中文字 ab" and (row.a, row.b) == ("SH", "SZ") and (row.f.date, row.f.company, row.f.institution, row.f.title) == ("2024-05-06", "某公司（600519.SH）", "", "券商")
    names = [("1_2024-01-02_某公司000001_中山证券_深度报告_买入.pdf", ("2024-01-02", "某公司（000001.SZ）", "中山证券", "深度报告买入", "买入")), ("1_2024-01-02_国金证券_周报.parsed.json", ("2024-01-02", "", "国金证券", "周报", "")),
             ("dir/2024-01-02_研究院_标题.PDF", ("2024-01-02", "", "研究院", "标题", "")), ("x.pdf", ("", "", "", "", "")), ("2024-01-02_某公司830001_甲_中邮证券_题.pdf", ("2024-01-02", "某公司（830001.BJ）", "中邮证券", "题", ""))]
    got = spark.createDataFrame([(n,) for n, _ in names], "n string").select("n", layout.file_fields(F.col("n")).alias("f")).collect()
    assert {r.n: tuple(r.f) for r in got} == dict(names)


def test_budget_and_pages(spark):
    texts = spark.createDataFrame([(1, k, "x" * 40) for k in range(4)], "doc_id int, ord int, text string")
    assert layout.within_budget(texts, ["doc_id"], ["ord"], 90).count() == 2 and layout.within_budget(texts, ["doc_id"], ["ord"], 5).count() == 1
    df = blocks(spark, [(1, 1, 0, "a", "text", 0.0, 700.0, 1.0, 800.0, "goes on"), (1, 2, 1, "b", "text", 0.0, 10.0, 1.0, 20.0, "here."), (1, 2, 2, "c", "text", 0.0, 30.0, 1.0, 40.0, "new")]).withColumn("height", F.lit(842.0))
    assert [r.joined for r in layout.continues_across_pages(df).orderBy("ord").collect()] == [1, 1, 2]
    assert [(r.text, r.block_ids) for r in layout.joined_texts(df).orderBy("joined").collect()] == [("goes on here.", ["a", "b"]), ("new", ["c"])]


REASONS = ("内容", "相关研究报告", "免责声明", "一、标题", "联系人", "风险提示：注意", "邮箱 a@b.cn", "北京", "1 .... 2 .... 3 .... 4 .... 5 .... 6 风险提示", "资料来源：甲", "图1 同比增长很多很多很多很多很多", "", "数", "图表目录")


def fold(rows, flags):
    """The cascade as a loop with state, over flags that are computed for each block by itself."""
    out, state, anchor = {}, None, None
    for r in rows:
        f, reason = flags[r["ord"]], None
        follows = anchor is not None and r["page"] == anchor["page"] and r["block_id"] != anchor["block_id"] and r["top"] >= anchor["bottom"] and (
            (r["x0"] >= 0.55 * 595 and anchor["x0"] >= 0.55 * 595) or max(0.0, min(r["x1"], anchor["x1"]) - max(r["x0"], anchor["x0"])) / min(max(1.0, r["x1"] - r["x0"]), max(1.0, anchor["x1"] - anchor["x0"])) >= 0.2
        )
        if not r["text"]:
            reason = "empty"
        elif f["toc"]:
            reason = "table_of_contents_page"
        elif f["edge"]:
            reason = "header_or_footer"
        elif r["type"] == "text" and f["contact"]:
            reason = "analyst_info"
        elif r["type"] == "text" and f["noise"]:
            reason = "text_noise"
        elif r["type"] == "title" and f["related"]:
            reason, state, anchor = "related_report_title", "related", r
        elif r["type"] == "title" and f["terminal"]:
            reason, state, anchor = "terminal_section_title", "terminal", r
        elif r["type"] == "title" and f["noisy"]:
            reason = "title_noise"
        elif state == "related" and follows and r["type"] in ("text", "title") and not f["risk"]:
            reason = "related_report_block"
        elif state == "terminal" and (r["page"] >= anchor["page"] or follows):
            reason = "terminal_section_block"
        elif f["source"]:
            reason = "source_only"
        elif r["type"] == "text" and f["listed"]:
            reason = "table_of_contents_noise"
        elif r["type"] == "figure" and not f["figure"]:
            reason = "low_quality_figure_ocr"
        if r["type"] == "title" and state != "terminal" and not f["related"] and not f["terminal"] and not f["skip"]:
            state = anchor = None
        if r["type"] == "text" and f["risk"] and not f["toc"] and reason != "table_of_contents_noise":
            reason = state = anchor = None
        if f["cover"] and f["contact"]:
            reason = "analyst_info"
        out[r["ord"]] = reason
    return out


def test_cascade_equals_a_fold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for doc in range(40):
        page = 1
        for k in range(int(rng.integers(5, 40))):
            page += int(rng.random() < 0.15)
            x0, top = float(rng.choice([20.0, 340.0])), float(rng.integers(0, 800))
            kind = str(rng.choice(["text", "title", "title", "table", "figure"]))
            rows.append((doc, page, k, f"b{k}", kind, x0, top, x0 + float(rng.choice([100.0, 500.0])), top + 20.0, str(rng.choice(REASONS)) if rng.random() < 0.6 else f"正文内容{rng.integers(0, 99)}很长的一段话。"))
    df = blocks(spark, rows)
    pages = spark.createDataFrame([], "doc_id int, page int, width double, height double")
    t = F.col("text")
    out = cascade.classified_blocks(df, pages)
    flags = out.join(cascade.contents_pages(df).withColumn("toc", F.lit(True)), ["doc_id", "page"], "left").select(
        "doc_id", "ord", "reason", "is_cover", F.coalesce("toc", F.lit(False)).alias("toc"), cascade.is_analyst_contact(t).alias("contact"), cascade.is_noise_text(t).alias("noise"), t.rlike(cascade.RELATED_REPORT).alias("related"),
        cascade.is_terminal_title(t).alias("terminal"), cascade.is_noisy_title(t).alias("noisy"), t.rlike(cascade.RISK).alias("risk"), (t.rlike(cascade.SOURCE_LINE) & cascade.is_source_only(t)).alias("source"),
        cascade.is_contents(t).alias("listed"), cascade.is_meaningful_figure(t).alias("figure"), t.rlike(cascade.SKIP_SECTION).alias("skip"),
    ).collect()
    names = ("doc_id", "page", "ord", "block_id", "type", "x0", "top", "x1", "bottom", "text")
    seen = set()
    for doc in range(40):
        mine = [dict(zip(names, r)) for r in rows if r[0] == doc]
        edges = {}
        for r in mine:
            if r["text"] and (r["top"] <= 0.08 * 842 or r["bottom"] >= 0.92 * 842):
                edges.setdefault(re.sub(r"\d+", "#", r["text"]), []).append(r["ord"])
        repeated = {k for v in edges.values() if len(v) >= 3 for k in v}
        f = {x.ord: {**x.asDict(), "cover": x.is_cover, "edge": x.ord in repeated} for x in flags if x.doc_id == doc}
        assert {k: x["reason"] for k, x in f.items()} == fold(mine, f)
        seen |= {x["reason"] for x in f.values()}
    assert len(seen) >= 12


def test_text_classes(spark):
    yes = {
        "is_analyst_contact": ["分析师：张三 S0123456789012345", "电话：010-8888 8888", "联系人 分析师李四"], "is_noisy_cover": ["ABCD EFGH IJKL MNOP 12", "WWW.EXAMPLE12345"], "is_company_token": ["某公司600519", "ABC12345"],
        "is_noisy_title": ["研究所", "北京", "table_1", "一"], "is_terminal_title": ["免责声明：", "评级说明"], "is_noise_text": ["", "上海", "XX行业周报"], "is_contents": ["目录", "1 .. 2 3 4 5 6", "一、甲 1 二、乙 2 三、丙 3"],
        "is_source_only": ["资料来源：甲", "资料来源：甲\n资料来源：乙乙"], "is_meaningful_figure": ["图1 近年来用电量同比增长情况一览表说明"],
    }
    no = {
        "is_analyst_contact": ["分析师认为收入增长很快很快很快，" + "长" * 60, "x" * 200 + "@"], "is_noisy_cover": ["短", "这是中文封面标题 2024 年度报告"], "is_company_token": ["国金证券600519", "公司"], "is_noisy_title": ["一、总论"],
        "is_terminal_title": ["声明"], "is_noise_text": ["这是正文。"], "is_contents": ["正文 1 2 3", ""], "is_source_only": ["资料来源：甲\n正文", ""], "is_meaningful_figure": ["1 2 3", "图1", ""],
    }
    for want, cases in ((True, yes), (False, no)):
        for name, texts in cases.items():
            got = spark.createDataFrame([(t,) for t in texts], "x string").select(getattr(cascade, name)(F.col("x")).alias("y")).collect()
            assert [r.y for r in got] == [want] * len(texts), name


def test_lines(spark):
    schema = "doc_id int, page int, ord int, x0 double, top double, x1 double, bottom double, text string"
    pages = spark.createDataFrame([(1, p, 600.0, 800.0) for p in (1, 2, 3)], "doc_id int, page int, width double, height double")
    lines = [(1, p, 0, 50.0, 20.0, 300.0, 32.0, f"某证券研究报告 {p}") for p in (1, 2, 3)] + [(1, 1, 1, 50.0, 100.0, 300.0, 112.0, "正文第一行"), (1, 1, 2, 50.0, 400.0, 80.0, 412.0, "- 3 -"), (1, 1, 3, 5.0, 300.0, 15.0, 310.0, "侧"), (1, 1, 4, 50.0, 500.0, 300.0, 512.0, "表内")]
    df = spark.createDataFrame(lines, schema)
    tables = spark.createDataFrame([(1, 1, 40.0, 490.0, 400.0, 600.0)], "doc_id int, page int, x0 double, top double, x1 double, bottom double")
    assert [r.text for r in layout.body_lines(df, tables, pages).collect()] == ["正文第一行"]
    rows = spark.createDataFrame([(1, 1, k, float(x), float(t), float(x + 20), float(t + 10), "x") for k, (x, t) in enumerate([(0, 0), (50, 4), (100, 7), (0, 20), (50, 22)])], schema)
    assert {r.ord: r.row_no for r in layout.visual_rows(rows).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}
    two = [(1, 1, k, 50.0 if k % 2 else 330.0, 20.0 * k, 250.0 if k % 2 else 530.0, 20.0 * k + 10, "x") for k in range(10)] + [(1, 1, 99, 50.0, 300.0, 550.0, 310.0, "wide")]
    got = {r.ord: (r.col_id, r.is_full_width) for r in layout.columns_of_lines(spark.createDataFrame(two, schema), pages).collect()}
    assert all(got[k] == (0 if k % 2 else 1, False) for k in range(10)) and got[99] == (0, True)
    ok = lambda cells, wide, high: layout.is_table(F.array(*(F.array(*map(F.lit, r)) for r in cells)), F.lit(wide), F.lit(high), F.lit(600.0), F.lit(800.0))
    row = spark.range(1).select(ok([["item", "2024"], ["revenue", "12345"]], 300.0, 50.0).alias("a"), ok([["item", "2024"]], 300.0, 50.0).alias("b"), ok([["item", "2024"], ["revenue", "12345"]], 50.0, 50.0).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, False)
    row = spark.range(1).select(layout.block_type(F.lit("Table caption")).alias("a"), layout.without_position_tags(F.lit("x@@1\t2.0\t3.0##y")).alias("b"), layout.box_of_positions(F.array(F.array(*map(F.lit, [2.0, 1.0, 9.0, 3.0, 4.0])), F.array(*map(F.lit, [2.0, 0.0, 5.0, 2.0, 8.0])))).alias("c")).first()
    assert (row.a, row.b, tuple(row.c)) == ("table", "xy", (2, 0.0, 2.0, 9.0, 8.0))


def test_surroundings(spark):
    texts = blocks(spark, [(1, 1, 0, "a", "text", 0.0, 10.0, 100.0, 20.0, "一。二。"), (1, 1, 1, "b", "text", 0.0, 30.0, 100.0, 40.0, "三。二。"), (1, 1, 2, "c", "text", 0.0, 200.0, 100.0, 210.0, "四。五。"), (1, 2, 3, "d", "text", 0.0, 10.0, 100.0, 20.0, "别页。")])
    table = blocks(spark, [(1, 1, 9, "t", "table", 0.0, 100.0, 100.0, 150.0, "")])
    assert [r.context for r in B.surrounding_sentences(table, texts).collect()] == ["一。 三。 二。"]
    assert [r.context for r in B.surrounding_sentences(table, texts.where("ord > 0"), 4).collect()] == ["三。 二。 四。 五。"]


def test_packing_by_characters(spark):
    parts = [("x" * 50 + "。" + "y" * 8, ["a"], [1], False), ("z" * 60, ["b"], [1], False), ("|t|" * 60, ["c"], [2], True), ("", ["d"], [2], False), ("tail", ["e"], [3], False)]
    out = chunking.pack_by_chars(parts, 100, 30)
    assert [c[1] for c in out] == [["a"], ["b"], ["c"], ["e"]] and out[1][0].startswith("y" * 8 + "\n\nz") and out[2][3] and out[2][0].endswith("|t|")
    df = spark.createDataFrame([(1, k, p[2][0], "table" if p[3] else "text", p[1][0], p[0]) for k, p in enumerate(parts)], "doc_id int, ord int, page int, type string, block_id string, text string")
    assert [(r.block_ids, r.char_count) for r in chunking.chunk_documents(df, 100, 30).orderBy("chunk_no").collect()] == [(c[1], len(c[0])) for c in out]
    assert chunking.tail_by_chars("abcd. tail", 10) == "tail" and chunking.tail_by_chars("a. long tail here", 17) == "a. long tail here" and chunking.tail_by_chars("x", 0) == ""
    assert [(a, b) for a, b, _ in chunking.row_groups("c", [["h"]], [["1"], ["2 2 2"], ["3"]], 14)] == [(1, 2), (3, 3)] and chunking.row_groups("c", [], [], 9) == []
