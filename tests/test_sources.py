"""Readers, writers and streams on files of their own."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark import evaluate, search
from quillspark.operators import answers, dense, index, lexical, tables
from quillspark.sources import readers, writers
from quillspark.streaming import incremental

BLOCKS = "doc_id int, ord int, block_id string, type string, page int, x0 double, top double, x1 double, bottom double, text string"


def test_documents_are_read_once(spark, tmp_path):
    doc = {"source": "/a/Report.PDF", "page_sizes": [{"page": 1, "width": 600.0, "height": 800.0}], "blocks": [{"id": "b1", "type": "title", "page": 1, "bbox": [1.0, 2.0, 3.0, 4.0], "text": "T"}, {"text": None}]}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.parsed.json").write_text(json.dumps(doc))
    (tmp_path / "y.parsed.json").write_text(json.dumps({"blocks": []}))
    (tmp_path / "other.json").write_text("{}")
    rows = readers.parsed_documents(spark, [str(tmp_path), str(tmp_path / "sub")])
    assert sorted(r.doc_id for r in rows.collect()) == ["Report", "y"]
    found = readers.document_blocks(rows).orderBy("ord").collect()
    assert [(r.block_id, r.type, r.page, r.bbox, r.text) for r in found] == [("b1", "title", 1, [1.0, 2.0, 3.0, 4.0], "T"), ("", "text", 0, [0.0] * 4, "")]
    assert readers.page_sizes(rows).collect()[0].width == 600.0


def test_chunk_files_and_docstore(spark, tmp_path):
    (tmp_path / "d.chunks.cs256.ov50.json").write_text(json.dumps({"chunks": [{"id": "c1", "text": None, "metadata": {"chunk_type": "text_chunk"}}]}))
    row = readers.chunk_files(spark, [str(tmp_path)] * 2).withColumn("c", readers.chunk_config(F.col("file"))).collect()
    assert len(row) == 1 and (row[0].doc_id, row[0].text, row[0].c.chunk_size, row[0].c.overlap) == ("d.chunks.cs256.ov50", "", 256, 50)
    store = tmp_path / "docstore.jsonl"
    store.write_text('{"docstore_id": "a", "faiss_id": 0, "indexed": true}\n\n{"docstore_id": "b", "indexed": false}\n')
    assert readers.indexed_records(readers.docstore(spark, str(store)), 1).count() == 1
    with pytest.raises(ValueError, match="expected"):
        readers.indexed_records(readers.docstore(spark, str(store)), 2)
    store.write_text('{"docstore_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.docstore(spark, str(store)).collect()


def test_results_and_checkpoints(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"queries": [{"qid": "1"}, {"qid": "2"}]}))
    assert [r.qid for r in readers.records_of(spark, str(tmp_path / "r.json"), "queries", "qid:string").collect()] == ["1", "2"]
    with pytest.raises(ValueError, match="no list"):
        readers.records_of(spark, str(tmp_path / "r.json"), "records", "qid:string")
    writers.append_checkpoint(spark.createDataFrame([("1", "fact")], "qid string, query_type string"), str(tmp_path / "c"))
    (tmp_path / "c" / "z.json").write_text('{"qid": "2"\n[]\n{"qid": "3"}\n')
    assert sorted(r.qid for r in readers.checkpoint_rows(spark, str(tmp_path / "c")).collect()) == ["1", "3"]
    assert readers.json_object(spark, str(tmp_path / "r.json")).count() == 1
    (tmp_path / "hub" / "models--o--m" / "snapshots" / "s1").mkdir(parents=True)
    assert readers.model_folder("o/m", str(tmp_path / "hub")).endswith("s1") and readers.model_folder(str(tmp_path)) == str(tmp_path.resolve())
    for name in ("o/none", "none"):
        with pytest.raises(ValueError):
            readers.model_folder(name, str(tmp_path / "hub"))


def test_lines_of_words(spark):
    words = [("d", 1, 0, 0, float(x), 10.0, float(x + 8), 20.0, w) for x, w in ((0, "a"), (10, "b"), (60, "c"))]
    df = spark.createDataFrame(words, "doc string, page int, block int, line int, x0 double, top double, x1 double, bottom double, word string")
    assert [(r.text, r.x1) for r in readers.lines_of_words(df).orderBy("part").collect()] == [("a b", 18.0), ("c", 68.0)]


def test_renderers(spark):
    df = spark.createDataFrame([(1, 0, "b1", "title", 1, 0.0, 0.0, 300.0, 80.0, "A<b"), (1, 1, "b2", "table", 1, 0.0, 100.0, 600.0, 900.0, "x")], BLOCKS)
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc_id int, page int, width double, height double")
    assert writers.as_markdown(df).first().markdown.startswith("### b1 | title | page 1 | bbox [0.0, 0.0, 300.0, 80.0]\n\nA<b\n\n### b2")
    html = writers.as_html(df, pages).first().html
    assert "left:0.0000%;top:0.0000%;width:50.0000%;height:10.0000%;" in html and "A&lt;b" in html
    assert [(r.file, r.box) for r in writers.crops(df, pages).collect()] == [("1_table_b2.png", [0.0, 98.0, 600.0, 800.0])]


def test_sinks(spark, tmp_path):
    store = spark.createDataFrame([("a", "p.pdf"), ("b", "q.pdf")], "docstore_id string, source_pdf string")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "docstore_id string, v array<double>")
    gone = spark.createDataFrame([("p.pdf",)], "source string")
    kept, held = writers.rebuilt(store, vectors, gone, spark.createDataFrame([("c", "r.pdf")], store.schema))
    assert sorted(r.docstore_id for r in kept.collect()) == ["b", "c"] and [r.docstore_id for r in held.collect()] == ["b"]
    assert [r.source for r in writers.new_sources(spark.createDataFrame([("q.pdf",), ("s.pdf",)], "source string"), store).collect()] == ["s.pdf"]
    results = spark.createDataFrame([("what is it?", "bm25", 1)], "query string, route string, rank int")
    writers.write_per_query(results, str(tmp_path / "o"))
    assert (tmp_path / "o" / "route=bm25" / "slug=what_is_it").is_dir()
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_per_query(results, str(tmp_path / "o"))


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox fox"), (3, "")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    incremental.index_stream(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    terms = spark.createDataFrame([("q", "fox", 1), ("q", "blue", 1)], "query_id string, term string, qtf long")
    want = lexical.top_k(lexical.bm25_scores(lexical.tokenized(docs, "doc_id", "text"), terms), 5).collect()
    assert incremental.search_stream(spark, str(tmp_path / "ix"), terms, 5).collect() == want and want[0].id == 2
    seen = []
    for _ in range(2):
        incremental.parse_stream(stream, lambda b: seen.append(b.count()) or b, str(tmp_path / "parsed"), str(tmp_path / "cp2")).awaitTermination()
    assert sum(seen) == 3
    turns = spark.createDataFrame([(1, k, "user", None if k == 2 else f"t{k}") for k in range(1, 4)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "turns"))
    query = incremental.last_turns(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns")), 2).writeStream.format("memory").queryName("turns").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.history for r in spark.table("turns").collect()] == ["user: \nuser: t3"]


def test_inverted_file(spark, tmp_path):
    rows = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.sin(F.col("id") * k * 0.7)).alias("v"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact = dense.exact_top_k(rows, asked, 5)
    assert sorted(dense.exact_top_k(rows, asked, 5, block=3).collect()) == sorted(exact.collect())
    built = dense.InvertedFile.build(rows, str(tmp_path / "ivf"), lists=8)
    assert sorted(built.search(asked, 5, probes=8).collect()) == sorted(exact.collect())
    few = built.search(asked, 5, probes=4)
    assert dense.overlap(few, exact, 5).agg(F.avg("overlap")).first()[0] >= 0.8
    assert dense.InvertedFile(spark, str(tmp_path / "ivf")).search(asked.limit(0), 5).count() == 0


def test_answers_and_sessions(spark):
    turns = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", "hello")], "conv_id int, turn int, role string, text string")
    found = spark.createDataFrame([(1, 1, "d", 0.9, "First fact。More."), (2, 1, "d", 0.1, "weak")], "query_id int, rank int, id string, score double, text string")
    seen = []

    def search(asked):
        seen.append({r.query_id: r.history for r in asked.collect()})
        return found

    session = answers.Session(turns, search)
    asked = spark.createDataFrame([(1, "what?"), (2, "why?")], "query_id int, query string")
    out = {r.query_id: json.loads(r.payload) for r in session.ask(asked).collect()}
    assert out[1]["answer"] == "First fact。" and out[1]["source"] == "extract" and out[2]["should_refuse"] and out[2]["answer"] == answers.REFUSAL
    assert out[1]["preview"][0]["text"] == "First fact。More." and seen[0] == {1: "user: hi\nassistant: hello", 2: ""}
    session.ask(asked.where("query_id = 1"))
    assert seen[1][1].endswith("user: what?\nassistant: First fact。")
    queries = spark.createDataFrame([("hi there",), ("price of x",), ("else",), ("odd",)], "query string")
    said = lambda q: F.when(q == "odd", "nonsense").otherwise("DIRECT")
    rows = {r["query"]: (r.decision, r.decided_by) for r in answers.routed(queries, ("hi",), ("price",), ("what",), said).collect()}
    assert rows == {"hi there": ("DIRECT", "words"), "price of x": ("RETRIEVE", "words"), "else": ("DIRECT", "model"), "odd": ("RETRIEVE", "default")}
    rows = {r["query"]: (r.search_query, r.query_type) for r in answers.rewritten(queries, lambda q: F.when(q == "odd", "no json").otherwise('x {"query": "new", "query_type": "compare"}')).collect()}
    assert rows["odd"] == ("odd", "fact") and rows["else"] == ("new", "compare") and answers.rewritten(queries).count() == 4


def test_index_of_odd_chunks(spark):
    rows = [("1_2024-01-01_a_b", 0, "c0", "cover_summary_chunk", "x\n公司： \n公司：Acme", None, None), ("1_2024-01-01_a_b", 1, "c1", "raw_table_chunk", "<t1>", "t1", "own"), ("1_2024-01-01_a_b", 2, "c2", "raw_table_chunk", "<t2>", "t1", None),
            ("1_2024-01-01_a_b", 3, "c3", "table_summary_chunk", "表名：N\n前后文：C", "t1", None), ("e", 0, "c4", "text_chunk", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, ord int, chunk_id string, chunk_type string, text string, table_id string, caption string")
    assert {r.doc_id: (r.title, r.company) for r in index.document_fields(df).collect()} == {"1_2024-01-01_a_b": ("a b", "Acme"), "e": ("e", "")}
    assert {r.chunk_id: r.raw_chunk_id for r in index.linked_tables(df, df).collect()}["c3"] == "c2"
    got = {r.chunk_id: (r.embedding_text, r.skip_reason) for r in index.docstore_records(df).collect()}
    assert got["c1"] == ("标题：a b\n公司：Acme\n前后文：C\n表名：N\n<t1>", None) and got["c4"][1] == "empty_text" and got["c0"][1] == "excluded_chunk_type:cover_summary_chunk"
    assert index.docstore_records(df.limit(0)).count() == 0


def test_tables_over_pages(spark):
    row = lambda n, page, top, bottom, rows, text="", x0=50.0: (1, n, f"t{n}", page, x0, top, bottom, 800.0, rows, text)
    head = [["h", "v"], ["a", "1"]]
    rows = [row(0, 1, 500.0, 700.0, head), row(1, 2, 20.0, 700.0, [["h ", "v"], ["b", "2"]]), row(2, 3, 20.0, 100.0, [["c", "3"]]), row(3, 3, 600.0, 790.0, head), row(4, 4, 20.0, 90.0, [["d", "4"]], "表 2：新"), row(5, 5, 20.0, 90.0, [["e", "4"]])]
    df = spark.createDataFrame(rows, "doc_id int, ord int, table_id string, page int, x0 double, top double, bottom double, height double, rows array<array<string>>, text string")
    got = {r.table_id: (r.table_ids, r.rows) for r in tables.continued_tables(df).collect()}
    assert got["t0"] == (["t0", "t1"], [["h", "v"], ["a", "1"], ["b", "2"]]) and set(got) == {"t0", "t2", "t3", "t4", "t5"}


def test_evaluation_over_settings(spark, tmp_path):
    docs = [("a", "red fox runs", ["b1"]), ("b", "blue whale swims", ["b2"]), ("c", "green frog", ["b3"]), *((f"z{k}", f"filler {k}", ["b"]) for k in range(5))]
    chunks = spark.createDataFrame([(f"{d}#{k}", d, t, b) for d, t, b in docs for k in range(2)], "chunk_id string, doc_id string, text string, block_ids array<string>")
    asked = spark.createDataFrame([(1, "fox"), (2, "whale"), (3, "nothing")], "query_id int, query string")
    gold = spark.createDataFrame([(1, "a", "b1"), (2, "b", "b2"), (3, "c", "b3")], "query_id int, doc_id string, block_id string")
    rows = evaluate.chunk_grid({(256, 50): chunks, (512, 50): chunks.where("doc_id != 'b'")}, asked, gold).collect()
    assert {(r.chunk_size, r.chunks): r.hit_at_3 for r in rows} == {(256, 16): round(2 / 3, 6), (512, 14): round(1 / 3, 6)}
    vectors = spark.range(40).select("id", F.array(F.sin("id"), F.cos("id")).alias("v"))
    queries = vectors.where("id < 2").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact = dense.exact_top_k(vectors, queries, 3)
    found = evaluate.index_comparison({"exact": lambda q, k: dense.exact_top_k(vectors, q, k), "none": lambda q, k: exact.limit(0)}, queries, exact, 3, 1)
    assert [(r["index"], r["overlap"]) for r in found] == [("exact", 1.0), ("none", 0.0)] and found[0]["ms"] > 0
    records = spark.createDataFrame([("1", "fact"), ("2", "fact"), ("3", "compare")], "qid string, query_type string")
    seen = []

    def score(todo):
        seen.append(sorted(r.qid for r in todo.collect()))
        return todo.withColumn("metrics", F.create_map(F.lit("m"), F.col("qid").cast("double"), F.lit("n"), F.when(F.col("qid") == "1", 0.5)))

    evaluate.judged(records, score, str(tmp_path / "judge"), limit=1).collect()
    means = {r.query_type: (r.n, r.m, r.n_n) for r in evaluate.judged(records, score, str(tmp_path / "judge")).collect()}
    assert seen == [["1"], ["2", "3"]] and means == {"fact": (2, 1.5, 1), "compare": (1, 3.0, 0), "average": (3, 2.0, 1)}


def test_search_of_an_index(spark, tmp_path):
    store = spark.createDataFrame([("c1", "d1", "red fox", True), ("c2", "d2", "blue fox fox", True), ("c3", "d3", "left out fox", False), *((f"z{k}", f"d{k}", "other words", True) for k in range(4, 9))], "docstore_id string, doc_id string, text string, indexed boolean")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0])], "docstore_id string, v array<double>")
    writers.write_index(store, vectors, spark.createDataFrame([(1,)], "n int"), str(tmp_path / "ix"))
    hits = search.run([str(tmp_path / "ix"), "blue fox", "--route", "bm25", "--top-k", "5", "--output", str(tmp_path / "out")], spark)
    assert [r.id for r in hits.orderBy("rank").collect()][0] == "c2" and hits.where("id = 'c3'").count() == 0 and (tmp_path / "out" / "route=bm25").is_dir()
    with pytest.raises(SystemExit):
        search.run([str(tmp_path / "ix"), "blue fox"], spark)
