import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import blocks, chunking, decompose, evaluation, evidence, fusion, lexical, ranking, tables
from quillspark.sources import readers, writers


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()[0]


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, T.clean_text(x), " 中 文　a  b\n\n\n\nc ") == "中文 a b\n\nc"
    assert one(spark, T.tokens(x), "中文ABC é-1.5%") == ["中文", "abc", "-1.5%"]
    assert one(spark, T.bigrams(T.tokens(x)), "中文字 ab") == ["中文", "文字", "ab"]
    assert one(spark, T.token_count(x), "中文 ab1.5, x") == 5
    assert one(spark, T.split_sentences(x), "甲。乙！ ") == ["甲。", "乙！"]
    assert one(spark, T.normalize_query(x), "甲，乙？ c:d") == "甲 乙 c d"
    assert one(spark, T.first_nonempty_line(x), "\n \n b \nc") == "b"
    assert one(spark, T.title_from_id(x), "12_2024-01-02_a_b") == "a b"
    assert [one(spark, T.title_level(x), t) for t in ("一、总论", "（二）分论", "3、细节", "2.1.3 节", "短标题", "这是一个句子。")] == [1, 2, 3, 3, 2, 0]
    assert one(spark, T.tokens(x), None) == [] and one(spark, T.token_count(x), None) == 0


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "d")], "id int, t string")
    asked = spark.createDataFrame([(9, "b b d")], "q int, t string")
    got = {r.id: r.score for r in lexical.bm25_scores(lexical.tokenized(docs, "id", "t"), lexical.query_terms(asked, "q", "t")).collect()}
    idf = math.log(2.5) - math.log(1.5)
    assert got[1] == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)))
    assert got[3] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 1 / 2)))
    assert set(got) == {1, 3}


def test_fusion_edges(spark):
    a = spark.createDataFrame([(1, 1, 10, 2.0), (1, 2, 11, 1.0)], "query_id int, rank int, id int, score double")
    b = spark.createDataFrame([(1, 1, 12, 5.0)], "query_id int, rank int, id int, score double")
    rows = fusion.weighted_sum(fusion.merged(a, b, 10), 0.5, 0.5, 10).orderBy("rank").collect()
    assert [(r.id, r.score) for r in rows] == [(10, 0.5), (12, 0.5), (11, 0.0)]
    rows = fusion.reciprocal_rank(fusion.merged(a, b.limit(0), 10), 10).orderBy("rank").collect()
    assert [r.id for r in rows] == [10, 11]


def test_ranking(spark):
    hits = spark.createDataFrame([(1, 0, r, i, g, 10.0 - r) for r, i, g in ((1, 5, "x"), (2, 6, "x"), (3, 7, "x"), (4, 8, "y"))], "query_id int, branch int, rank int, id int, g string, score double")
    assert [r.id for r in ranking.per_group_cap(hits, ["query_id"], "g").orderBy("rank").collect()] == [5, 6, 8]
    more = hits.unionByName(hits.withColumn("branch", F.lit(1)).withColumn("score", F.col("score") + 0.5))
    assert [r.id for r in ranking.branch_union(more, 2, 10).orderBy("rank").collect()] == [5, 6]
    assert [r.id for r in ranking.quota_merge(more, 1, 1, 10).orderBy("rank").collect()] == [5, 6]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, r, i) for r, i in ((1, 50), (2, 51), (3, 52))], "query_id int, rank int, id int")
    gold = spark.createDataFrame([(1, 0, 51), (1, 0, 99), (1, 1, 52), (2, 0, 1)], "query_id int, component int, id int")
    rows = {r.query_id: r for r in evaluation.grouped_metrics(hits, gold).collect()}
    assert (rows[1].recall_at_3, rows[1].mrr, rows[1].any_hit) == (1.0, round(1 / 3, 6), 1.0)
    assert (rows[2].recall_at_10, rows[2].mrr, rows[2].ndcg_local) == (0.0, 0.0, 0.0)
    import math

    assert rows[1].ndcg_local == pytest.approx((1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3)), abs=1e-6)


def test_sections_and_cleaning(spark):
    rows = [(1, 0, 1, "title", "一、总论"), (1, 1, 1, "text", "甲"), (1, 2, 1, "title", "（一）分论"), (1, 3, 1, "text", "乙"), (1, 4, 2, "title", "相关研究"), (1, 5, 2, "text", "丙报告"),
            (1, 6, 2, "title", "二、其他"), (1, 7, 2, "text", "丁"), (1, 8, 3, "title", "免责声明"), (1, 9, 3, "text", "戊"), (1, 10, 3, "text", "风险提示：己"), (1, 11, 3, "text", "")]
    df = spark.createDataFrame(rows, "doc_id int, ord int, page int, type string, text string")
    got = {r.ord: (r.section, r.subsection) for r in blocks.assign_sections(df).collect()}
    assert got[1] == ("一、总论", "") and got[3] == ("一、总论", "（一）分论") and got[7] == ("二、其他", "")
    lone = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("a", 4.0)], "kind string, value double")
    means = {r.kind: (r.n, r.value) for r in evaluation.rollup_means(lone, "kind", ["value"]).collect()}
    assert means == {None: (1, 1.0), "a": (2, 3.0), "average": (3, round(7 / 3, 6))}


def plain_pack(units, size, overlap):
    """Packing by its definition, a unit at a time."""
    out, held, seed, page = [], [], "", 0

    def text_of():
        return "\n\n".join(t for t in [seed, *(u[0] for u in held)] if t)

    for unit in [*units, None]:
        spent = chunking.count_tokens(seed) + sum(chunking.count_tokens(u[0]) for u in held)
        if held and (unit is None or spent + chunking.count_tokens(unit[0]) > size):
            text, pages = text_of(), [p for p in [page, *(u[2] for u in held)] if p]
            out.append((text, [b for u in held for b in u[1]], min(pages), max(pages)))
            seed, page, held = chunking.overlap_tail(text, overlap), max(pages), []
        if unit is not None:
            held.append(unit)
    return out


def test_chunks_equal_a_plain_fold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for doc in range(6):
        for k in range(int(rng.integers(0, 25))):
            words = " ".join(f"w{x}" + ("。" if x % 7 == 0 else "") for x in rng.integers(0, 50, int(rng.integers(0, 40))))
            rows.append((doc, "s" if k % 9 else "t", "", k, 1 + k // 4, f"b{k}", words))
    units = spark.createDataFrame(rows, "doc_id long, section string, subsection string, ord int, page int, block_id string, text string")
    got = {}
    for r in chunking.chunk_sections(units, 30, 8).orderBy("doc_id", "section", "chunk_no").collect():
        got.setdefault((r.doc_id, r.section), []).append((r.text, r.block_ids, r.page_start, r.page_end))
    want = {}
    for key in sorted({(r[0], r[1]) for r in rows}):
        items = []
        for r in (r for r in rows if (r[0], r[1]) == key):
            items += [(p, [r[5] if n == 0 else f"{r[5]}#part{n + 1}"], r[4]) for n, p in enumerate(chunking.split_long(r[6], 30))]
        if items:
            want[key] = [(t.strip(), list(dict.fromkeys(b)), x, y) for t, b, x, y in plain_pack(items, 30, 8)]
    assert got == want and any("#part2" in b for chunks in got.values() for c in chunks for b in c[1])


def test_chunk_packing():
    units = [(f"w{k} " * 10, [f"b{k}"], 1 + k // 3) for k in range(7)]
    out = chunking.pack_units(units, 25, 0)
    assert [c[1] for c in out] == [["b0", "b1"], ["b2", "b3"], ["b4", "b5"], ["b6"]]
    assert [(c[2], c[3]) for c in out] == [(1, 1), (1, 2), (2, 2), (3, 3)]
    out = chunking.pack_units([("一二三。四五六。", ["a"], 1), ("七八九十。", ["b"], 1)], 8, 4)
    assert out[1][0].startswith("四五六。") and out[1][1] == ["b"]
    assert chunking.pack_units([], 10, 5) == [] and chunking.split_long("", 5) == []
    long = "甲乙丙丁戊己庚辛。" * 3
    assert "".join(chunking.split_long(long, 4)) == long and max(map(chunking.count_tokens, chunking.split_long(long, 4))) <= 4


def test_tables(spark):
    html = "<table><caption>营收表 资料来源：x</caption><tr><th>项目</th><th>2024</th></tr><tr><td>收入</td><td>5</td></tr><tr><td>利润</td><td>n/a</td></tr></table>"
    t = tables.parse(F.col("x"))
    row = spark.createDataFrame([(html,), ("",), (None,)], "x string").select(t.alias("t"), tables.summary(t).alias("s"), tables.to_markdown(F.array(F.lit("a|b")), F.array(F.array(F.lit("1"), F.lit("2")))).alias("m")).collect()
    assert row[0].t.caption == "营收表" and row[0].t.rows == [["收入", "5"], ["利润", "n/a"]] and row[0].s == "收入: 2024=5"
    assert row[1].t.rows == [] and row[2].s == ""
    assert row[0].m == "| a\\|b |  |\n| --- | --- |\n| 1 | 2 |"


def test_merge_over_pages(spark):
    t = "struct<caption:string,headers:array<array<string>>,rows:array<array<string>>>"
    rows = [(1, 0, 1, "s", "", ("表甲", [["a", "b"]], [["1", "2"]]), False), (1, 1, 2, "s", "", ("", [], [["3", "4"]]), True), (1, 2, 3, "s", "", ("表乙", [["a", "b"]], [["5", "6"]]), True)]
    df = spark.createDataFrame(rows, f"doc_id int, ord int, page int, section string, subsection string, table {t}, prev_is_table boolean")
    got = tables.merge_over_pages(df).orderBy("table_no").collect()
    assert [(r.page_start, r.page_end, r.caption, r.rows) for r in got] == [(1, 2, "表甲", [["1", "2"], ["3", "4"]]), (3, 3, "表乙", [["5", "6"]])]


def test_evidence(spark):
    claims = F.array(F.struct(F.lit(" a ").alias("claim"), F.array(F.lit("E1"), F.lit("E9")).alias("citations")), F.struct(F.lit(" ").alias("claim"), F.array(F.lit("E1")).alias("citations")))
    row = spark.range(1).select(evidence.valid_claims(claims, F.array(F.lit("E1"))).alias("c")).select("c", evidence.used_evidence(F.col("c")).alias("u")).first()
    assert row.c[0].claim == "a" and row.u == ["E1"] and len(row.c) == 1
    hits = spark.createDataFrame([(1, 0.4), (2, 0.6)], "query_id int, s double")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    assert {r.query_id: r.should_refuse for r in evidence.refusals(asked, hits, "s").collect()} == {1: True, 2: False, 3: True}
    parsed = spark.createDataFrame([('x {"a": 1} y',), ("none",)], "x string").select(evidence.from_json_text(F.col("x"), "a int").alias("j")).collect()
    assert parsed[0].j.a == 1 and parsed[1].j is None


def test_entities_do_not_overlap(spark):
    names = F.array(F.lit("公司"), F.lit("甲公司"), F.lit("乙公司"))
    spans = one(spark, decompose.entity_spans(F.col("x"), names), "乙公司和甲公司")
    assert [s.name for s in spans] == ["乙公司", "甲公司"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.parsed.json").write_text(json.dumps({"source": "x/Doc.PDF", "blocks": [{"id": "b1", "type": "title", "page": 1, "text": "t"}, {"text": "u"}]}))
    got = readers.document_blocks(readers.parsed_documents(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(r.doc_id, r.block_id, r.type, r.page, r.text) for r in got] == [("Doc", "b1", "title", 1, "t"), ("Doc", "", "text", 0, "u")]
    log = tmp_path / "log.jsonl"
    log.write_text('{"qid": "1", "metrics": {"m": 0.5}}\nnot json\n{"metrics": {}}\n')
    assert [r.qid for r in readers.checkpoint_rows(spark, str(log)).collect()] == ["1"]
    chunks = tmp_path / "c"
    chunks.mkdir()
    (chunks / "n.json").write_text(json.dumps({"chunks": [{"id": "c1", "text": "t"}]}))
    assert [(r.doc_id, r.chunk_id) for r in readers.chunk_files(spark, str(chunks)).collect()] == [("n", "c1")]
    rows = spark.createDataFrame([("flat", p) for p in readers.PARTS] + [("a_hnsw", p) for p in readers.PARTS] + [("b", "docstore")], "index string, part string")
    assert {r["index"]: (r.complete, r.preferred) for r in readers.index_catalog(rows).collect()} == {"flat": (True, False), "a_hnsw": (True, True), "b": (False, False)}


def test_writers(spark, tmp_path):
    store = spark.createDataFrame([("d1", "text", True), ("d1", "table", False), ("d2", "text", True)], "doc_id string, chunk_type string, indexed boolean")
    meta = writers.build_meta(store).first()
    assert (meta.documents, meta.records, meta.indexed, meta.by_type) == (2, 3, 2, {"table": 1, "text": 2})
    results = store.withColumn("route", F.lit("bm25"))
    writers.write_results(results, str(tmp_path / "r"))
    with pytest.raises(Exception, match="exists|EXISTS"):
        writers.write_results(results, str(tmp_path / "r"))


def test_streams(spark, sf, tmp_path):
    from quillspark.streaming import incremental

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    incremental.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/lengths")).count() == docs.count()
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert incremental.event_counts(events).agg(F.sum("n")).first()[0] == events.count()
