"""Chunks of every kind from blocks, packing and tables over pages, against what they are by definition."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import cascade, chunking, index, tables, typed

WORDS = ["a", "bb", "ccc。", "甲", "乙。", " ", "x1.5", "\n", "；"]


def some(rng, n):
    return "".join(rng.choice(WORDS) for _ in range(n))


def fold_chars(blocks, most, overlap):
    """A block at a time: closes before what would exceed, and once full."""
    out, parts, ids, pages, table = [], [], [], set(), False
    for k, (text, names, on, is_table) in enumerate([b for b in blocks if b[0]] + [("", [], [], False)]):
        for full in (False, True):
            joined = len("\n\n".join(parts))
            last = not text and k >= 0
            if (full and joined >= most and parts) if text and full else (not full and parts and (joined + len(text) + 2 > most if text else bool(ids))):
                body = "\n\n".join(p for p in parts if p.strip()).strip()
                if body:
                    out.append((body, ids, sorted(pages), table))
                tail = chunking.tail_by_chars(body, overlap) if body else ""
                parts, ids, pages, table = [tail] if tail else [], [], set(), False
            if text and not full:
                parts, ids, pages, table = [*parts, text], ids + names, pages | set(on), table or is_table
            if last:
                break
    return out


def fold_apart(blocks, most, overlap):
    out, held = [], []

    def close():
        nonlocal held
        if held:
            text = "\n\n".join(b[0] for b in held)
            out.append((text, [i for b in held for i in b[1]], sorted({p for b in held for p in b[2]}), any(b[3] for b in held)))
            tail = chunking.tail_by_chars(text, overlap)
            held = [(tail, [f"overlap_{len(out):04d}"], [out[-1][2][-1]], False)] if tail else []

    for b in blocks:
        if b[3]:
            close()
            held = [b]
            close()
        else:
            if held and sum(len(x[0]) for x in held) + len(b[0]) > most:
                close()
            held.append(b)
    close()
    return out


@pytest.mark.parametrize("seed", range(3))
def test_packing_by_search_equals_a_fold(seed):
    rng = random.Random(seed)
    for _ in range(300):
        blocks = [(some(rng, rng.randint(0, 30)), [f"b{k}"], [rng.randint(0, 3)], rng.random() < 0.2) for k in range(rng.randint(0, 9))]
        most, overlap = rng.randint(5, 60), rng.randint(0, 30)
        assert chunking.pack_by_chars(blocks, most, overlap) == fold_chars(blocks, most, overlap)
        assert chunking.pack_apart(blocks, most, overlap) == fold_apart(blocks, most, overlap)
    assert chunking.cuts([3, 3, 9, 1, 1, 0, 7], 6) == [0, 2, 3, 6, 7] and chunking.cuts([], 4) == []


def test_tables_are_chunks_of_their_own(spark):
    rows = [(1, 0, 1, "text", "b0", "one"), (1, 1, 1, "table", "b1", "| t |"), (1, 2, 1, "text", "b2", "two")]
    df = spark.createDataFrame(rows, "doc_id int, ord int, page int, type string, block_id string, text string")
    assert [(r.block_ids, r.contains_table) for r in chunking.chunk_documents(df, 100, 0, apart=True).orderBy("chunk_no").collect()] == [(["b0"], False), (["b1"], True), (["b2"], False)]
    assert chunking.chunk_documents(df, 100, 0).count() == 1 and chunking.chunk_documents(df.limit(0), apart=True).count() == 0


def continued_by_hand(held):
    """A table at a time: the first ones of a page against the last that stayed on the page before."""
    out = []
    for t in held:
        on_page = [o for o in out if o["page"] == t["page"]]
        before = next((o for o in reversed(out) if o["page"] == t["page"] - 1), None) if not on_page else None
        wide = lambda rows: max(map(len, rows), default=0)
        if before and before["bottom"] >= 0.76 * 800 and t["top"] <= 0.24 * 800 and abs(before["x0"] - t["x0"]) <= 70 and wide(before["rows"]) == wide(t["rows"]) >= 2 and not t["text"].startswith("表"):
            more = t["rows"][1:] if [c.strip() for c in t["rows"][0]] == [c.strip() for c in before["rows"][0]] else t["rows"]
            n = max(map(len, before["rows"] + more))
            before["rows"] = [r + [""] * (n - len(r)) for r in before["rows"] + more]
            before["pages"] = sorted({*before["pages"], t["page"]})
            before["table_ids"] = [*before["table_ids"], t["table_id"]]
        else:
            out.append({**t, "pages": [t["page"]], "table_ids": [t["table_id"]]})
    return sorted((t["doc_id"], t["table_id"], t["page"], t["pages"], t["table_ids"], t["rows"]) for t in out)


def test_continued_tables_by_hand(spark):
    rng = random.Random(3)
    held = []
    for doc in range(40):
        ord_ = 0
        for page in sorted(rng.sample(range(1, 9), rng.randint(1, 7))):
            for _ in range(rng.randint(1, 3)):
                rows = [[rng.choice(["h", " h", "v"]) for _ in range(rng.choice([1, 2, 2, 2, 3]) if k == 0 or rng.random() < 0.2 else 2)] for k in range(rng.randint(0 if rng.random() < 0.1 else 1, 3))]
                held.append({"doc_id": doc, "ord": ord_, "table_id": f"t{ord_}", "page": page, "x0": rng.choice([50.0, 50.0, 90.0, 200.0]), "top": rng.choice([10.0, 20.0, 500.0]), "bottom": rng.choice([700.0, 790.0, 300.0]), "height": 800.0, "rows": rows, "text": rng.choice(["", "", "", "表 1：x"])})
                ord_ += 1
    df = spark.createDataFrame([tuple(t.values()) for t in held], "doc_id int, ord int, table_id string, page int, x0 double, top double, bottom double, height double, rows array<array<string>>, text string")
    got = sorted((r.doc_id, r.table_id, r.page, r.pages, r.table_ids, r.rows) for r in tables.continued_tables(df).collect())
    want = [x for doc in range(40) for x in continued_by_hand([dict(t) for t in held if t["doc_id"] == doc])]
    assert got == sorted(want) and any(len(x[4]) > 2 for x in want) and any(x[3][0] + 1 == x[3][-1] for x in want)


def test_what_a_table_has_so_far_decides(spark):
    """A caption or header of an earlier table is forgotten when a new one begins; a header that comes late counts."""
    t = "struct<caption:string,headers:array<array<string>>,rows:array<array<string>>>"
    rows = [(1, 0, 1, "甲", [["a", "b"]], 2), (1, 1, 3, "", [], 2), (1, 2, 4, "甲", [], 2), (1, 3, 6, "", [], 2), (1, 4, 7, "", [["x", "y"]], 2), (1, 5, 8, "", [["x", "z"]], 2), (1, 6, 10, "", [], 3), (1, 7, 11, "", [], 0), (1, 8, 12, "", [], 2)]
    df = spark.createDataFrame([(d, o, p, "s", "", (c, h, [["1"] * n] if n else [])) for d, o, p, c, h, n in rows], f"doc_id int, ord int, page int, section string, subsection string, table {t}")
    got = [(r.page_start, r.page_end, r.headers) for r in tables.merge_over_pages(df).orderBy("table_no").collect()]
    assert got == [(1, 1, [["a", "b"]]), (3, 3, None), (4, 4, None), (6, 7, [["x", "y"]]), (8, 8, [["x", "z"]]), (10, 11, None), (12, 12, None)]


BLOCKS = "doc_id string, ord int, block_id string, page int, type string, x0 double, top double, x1 double, bottom double, text string"


def test_blocks_to_docstore(spark):
    html = "<table><caption>营收表</caption><tr><th>项目</th><th>2024</th></tr><tr><td>收入</td><td>5</td></tr></table>"
    rows = [
        ("r", 0, "b0", 1, "title", 40.0, 20.0, 500.0, 40.0, "公司深度报告"), ("r", 1, "b1", 1, "text", 40.0, 60.0, 500.0, 80.0, "评级：买入"), ("r", 2, "b2", 1, "text", 400.0, 100.0, 500.0, 120.0, "国金证券"),
        ("r", 3, "b3", 1, "text", 40.0, 300.0, 500.0, 320.0, "公司全年收入增长明显，利润率继续改善，我们看好其后续的发展。后文。"), ("r", 4, "b4", 2, "title", 40.0, 100.0, 500.0, 120.0, "一、总论"),
        ("r", 5, "b5", 2, "text", 40.0, 140.0, 500.0, 160.0, "上文一。上文二。"), ("r", 6, "b6", 2, "table", 40.0, 200.0, 500.0, 300.0, html), ("r", 7, "b7", 3, "table", 40.0, 100.0, 500.0, 300.0, html.replace("收入", "利润").replace("营收表", "")),
        ("r", 8, "b8", 3, "figure", 40.0, 400.0, 500.0, 500.0, "图1 收入走势图同比增长，公司各季度\n同比增长 12%"), ("r", 9, "b9", 3, "text", 40.0, 600.0, 500.0, 620.0, "下文。"),
    ]
    df = spark.createDataFrame(rows, BLOCKS)
    pages = spark.createDataFrame([("r", p, 595.0, 842.0) for p in (1, 2, 3)], "doc_id string, page int, width double, height double")
    sources = spark.createDataFrame([("r", "1_2024-01-02_甲药业600123.pdf"), ("none", "x.pdf")], "doc_id string, source string")
    chunks = typed.chunk_documents_typed(cascade.classified_blocks(df, pages), sources, 64, 10).cache()
    got = {r.chunk_id: r for r in chunks.collect()}
    assert got["r__cover_summary_0001"].text == "标题：甲药业600123\n公司：甲药业（600123.SH）\n机构：国金证券\n日期：2024-01-02\n评级：买入\n核心观点：公司全年收入增长明显，利润率继续改善，我们看好其后续的发展。"
    assert got["none__cover_summary_0001"].text == "标题：none" and got["none__cover_summary_0001"].block_ids == []
    table, note = got["r__raw_table_0001"], got["r__table_summary_0001"]
    assert table.block_ids == ["b6", "b7"] and (table.page_start, table.page_end, table.n_rows, table.caption) == (2, 3, 2, "营收表") and table.context == "上文一。 上文二。"
    assert note.text == "表名：营收表\n所属章节：一、总论\n前后文：上文一。 上文二。\n关键指标：收入: 2024=5；利润: 2024=5" and note.table_id == "table_0001"
    assert got["r__figure_summary_0001"].text.startswith("图名：图1 收入走势图") and "趋势描述：" in got["r__figure_summary_0001"].text and got["r__figure_summary_0001"].figure_id == "figure_0001"
    texts = [r for r in got.values() if r.chunk_type == "text_chunk"]
    assert {r.section for r in texts} == {"正文", "一、总论"} and any(r.text.startswith("一、总论\n\n上文一。") for r in texts)
    records = {r.chunk_id: r for r in index.docstore_records(chunks).collect()}
    assert records["r__raw_table_0001"].indexed and "前后文：上文一。 上文二。\n表名：营收表" in records["r__raw_table_0001"].embedding_text and not records["r__cover_summary_0001"].indexed
    assert {r["name"]: r.n for r in index.load_summary(index.docstore_records(chunks)).where("kind = 'tables'").collect()} == {"summaries": 1, "matched": 1}
    assert typed.chunk_documents_typed(cascade.classified_blocks(df.limit(0), pages), sources).count() == 2
    assert {r.chunk_type for r in typed.chunk_documents_typed(cascade.classified_blocks(df, pages), sources, figures=False).collect()} == {"cover_summary_chunk", "text_chunk", "raw_table_chunk", "table_summary_chunk"}


def test_titles_of_embedding_texts(spark):
    rows = [("a_1", 1, "text_chunk", "标题：not this", "\n标题：From the text\nx"), ("a_1", 0, "text_chunk", "x", "x"), ("b", 0, index.COVER, "标题：Cover", "标题：Other"), ("2_2024-01-01_c", 0, "text_chunk", None, None)]
    df = spark.createDataFrame(rows, "doc_id string, ord int, chunk_type string, text string, embedding_text string")
    assert {r.doc_id: r.title for r in index.document_fields(df).collect()} == {"a_1": "From the text", "b": "Cover", "2_2024-01-01_c": "c"}
