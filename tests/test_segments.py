"""Segmented index, dictionary words and names against rebuilt indexes and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import segment, text as T
from quillspark.operators import cascade, decompose, dense, lexical
from quillspark.streaming import incremental, segments

DOCS = [(k, " ".join(f"w{(k * j) % 13}" for j in range(1, 4 + k % 6))) for k in range(1, 31)]


def rebuilt(spark, state, asked, k=50):
    docs = spark.createDataFrame(sorted(state.items()), "doc_id long, text string")
    return hits(lexical.top_k(lexical.bm25_scores(lexical.tokenized(docs, "doc_id", "text"), lexical.query_terms(asked, "query_id", "query")), k))


def hits(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 3)) for r in df.collect())


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "w3 w5"), (2, "w12 w0 w1"), (3, "absent")], "query_id int, query string")


def test_changes_equal_a_rebuild(spark, tmp_path, asked):
    index = segments.SegmentedIndex(spark, str(tmp_path / "ix"))
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert index.generation() == 0 and index.ask(asked, 5).count() == 0
    state = dict(DOCS[:20])
    index.add(table(DOCS[:20]), "first")
    assert hits(index.ask(asked, 50)) == rebuilt(spark, state, asked)
    index.add(table([(3, "w3 w3 w3"), (4, ""), (5, None), (25, "w5 w0"), (3, "w1")]), "second")
    state |= {3: "w3 w3 w3", 4: "", 5: "", 25: "w5 w0"}
    index.delete(table([(7, ""), (8, ""), (99, ""), (None, "")]))
    state = {k: v for k, v in state.items() if k not in (7, 8)}
    index.add(table([(8, "w12 back")]))
    state[8] = "w12 back"
    want = rebuilt(spark, state, asked)
    assert hits(index.ask(asked, 50)) == want
    # a change that comes again under its name counts once, also after a compaction
    g = index.generation()
    index.add(table([(3, "other")]), "second")
    assert index.generation() == g
    index.compact()
    index.add(table([(3, "other")]), "second")
    assert hits(index.ask(asked, 50)) == want and len([1 for _, _, k in index.manifest() if k == "add"]) == 1
    index.vacuum()
    assert hits(segments.SegmentedIndex(spark, str(tmp_path / "ix")).ask(asked, 50)) == want and len([n for n in index._files("postings") if "=" in n]) == 1
    index.delete(table([(k, "") for k in state]))
    assert index.ask(asked, 5).count() == 0 and index.alive()[1].count() == 0


def test_a_write_that_broke_off_is_not_seen(spark, tmp_path, asked):
    import shutil

    index = segments.SegmentedIndex(spark, str(tmp_path / "ix"))
    index.add(spark.createDataFrame(DOCS[:9], "doc_id long, text string"))
    shutil.copytree(tmp_path / "ix/postings/segment=1", tmp_path / "ix/postings/segment=2")  # a segment without its manifest
    (tmp_path / "ix/manifests/generation=2").mkdir()
    assert index.generation() == 1 and hits(index.ask(asked, 50)) == rebuilt(spark, dict(DOCS[:9]), asked)
    index.add(spark.createDataFrame([(1, "w5")], "doc_id long, text string"))
    assert hits(index.ask(asked, 50)) == rebuilt(spark, dict(DOCS[:9]) | {1: "w5"}, asked)


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    no_quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    none = spark._jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(none, False, False, no_quantiles, none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_search_shuffles_no_pairs(spark, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path / "ix"))
    index.add(spark.range(3000).selectExpr("id AS doc_id", "concat('all w', id % 7, ' w', id % 11) AS text"))
    index.delete(spark.range(0, 3000, 10).toDF("doc_id"))
    asked = spark.range(20).selectExpr("id AS query_id", "concat('all w', id % 9) AS query")
    before = shuffled(spark)
    index.compact()
    assert len(index.ask(asked, 5).collect()) == 100
    assert shuffled(spark) - before < 12_000  # the names of documents and some best rows a task; pairs are 54,000, postings 8,100 at each step
    assert spark.read.parquet(str(tmp_path / "ix/postings/segment=3")).count() == 2700  # a row a document


def test_many_superseded_documents(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(segments, "BROADCAST_GONE", 2)
    index = segments.SegmentedIndex(spark, str(tmp_path / "ix"))
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.add(table(DOCS[:20]))
    index.add(table([(k, "w5 w0") for k in range(1, 9)]))
    index.delete(table([(k, "") for k in range(5, 12)]))
    index.add(table([(6, "w12 back")]))
    state = dict(DOCS[11:20]) | {k: "w5 w0" for k in range(1, 5)} | {6: "w12 back"}
    want = rebuilt(spark, state, asked)
    assert hits(index.ask(asked, 50)) == want
    index.compact()
    assert hits(index.ask(asked, 50)) == want
    postings, lengths = index.alive()
    assert {r.doc_id: r.dl for r in lengths.collect()} == {k: len(t.split()) for k, t in state.items()}
    assert sum(r.tf for r in postings.collect()) == sum(len(t.split()) for t in state.values())


def test_an_earlier_layout_is_refused(spark, tmp_path):
    (tmp_path / "ix/lengths/segment=1").mkdir(parents=True)
    with pytest.raises(ValueError, match="earlier layout"):
        segments.SegmentedIndex(spark, str(tmp_path / "ix"))


def test_stream_of_documents_that_come_again(spark, tmp_path, asked):
    given, state = tmp_path / "in", {}
    for n, rows in enumerate([DOCS[:8], [(1, "w5 w5"), (9, "w3")], [(2, "w0")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(given))
        state |= dict(rows)
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(given))
        incremental.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    terms = lexical.query_terms(asked, "query_id", "query")
    assert hits(incremental.search_stream(spark, str(tmp_path / "out"), terms, 50)) == rebuilt(spark, state, asked)
    assert incremental.indexed_stream(spark, str(tmp_path / "out"))[1].count() == len(state)


def test_upload_to_search(spark, tmp_path):
    blocks = "doc_id string, ord int, block_id string, page int, type string, x0 double, top double, x1 double, bottom double, text string"
    row = lambda d, k, t: (d, k, f"b{k}", 2, "text", 40.0, 100.0 + 40 * k, 500.0, 120.0 + 40 * k, t)
    pages = spark.createDataFrame([(d, 2, 595.0, 842.0) for d in "ab"], "doc_id string, page int, width double, height double")
    sources = lambda *ids: spark.createDataFrame([(d, f"{d}.pdf") for d in ids], "doc_id string, source string")
    index = segments.SegmentedIndex(spark, str(tmp_path / "ix"), T.bigrams, "string")
    first = spark.createDataFrame([row("a", 0, "收入增长很快。"), row("a", 1, "green fox"), row("b", 0, "blue whale"), *(row(f"z{k}", 0, f"filler {k}") for k in range(9))], blocks)
    records = segments.upload(index, cascade.classified_blocks(first, pages), sources("a", "b", *(f"z{k}" for k in range(9))), 8, 0)
    assert {r.chunk_type for r in records.where("indexed").collect()} == {"text_chunk"} and records.where("chunk_type = 'cover_summary_chunk'").count() == 11
    asked = spark.createDataFrame([(1, "fox"), (2, "收入"), (3, "whale")], "query_id int, query string")
    assert {r.query_id: r.id.split("__")[0] for r in index.ask(asked, 1).collect()} == {1: "a", 2: "a", 3: "b"}
    again = spark.createDataFrame([row("a", 0, "red dog")], blocks)
    segments.upload(index, cascade.classified_blocks(again, pages), sources("a"), 8, 0)
    assert {r.query_id for r in index.ask(asked, 1).collect()} == {3}


# ---- words of a dictionary


def best_of_all(run, counts):
    total = math.log(sum(counts.values()))
    weight = lambda w: math.log(counts[w]) - total if w in counts else -total if len(w) == 1 else None
    best = None
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        cuts = [0, *(k + 1 for k, m in enumerate(marks) if m), len(run)]
        words = [run[a:b] for a, b in zip(cuts, cuts[1:])]
        weights = [weight(w) for w in words]
        if None not in weights:
            score = 0.0
            for w in reversed(weights):
                score = w + score
            if best is None or score > best[0] + 1e-12:
                best = (score, words)
    return best


def test_segmentation_is_the_likeliest():
    rng = random.Random(4)
    chars = "甲乙丙丁戊"
    for _ in range(150):
        counts = {"".join(rng.choice(chars) for _ in range(rng.randint(1, 4))): rng.randint(1, 99) for _ in range(rng.randint(1, 25))}
        d = segment.Dictionary(counts.items())
        run = "".join(rng.choice(chars) for _ in range(rng.randint(1, 10)))
        words = d.split(run)
        assert "".join(words) == run
        score = 0.0
        for w in reversed(words):
            score = d.weights.get(w, -d.total) + score
        assert score == pytest.approx(best_of_all(run, counts)[0], abs=1e-9)
    assert segment.Dictionary([]).split("甲乙") == ["甲", "乙"] and segment.Dictionary([("甲乙", None), ("", 3), ("甲", 0)]).split("甲乙丙") == ["甲乙", "丙"]


def test_search_with_a_dictionary(spark):
    lines = spark.createDataFrame([("中国 90 n",), ("人民 80",), ("国人 1",), ("民",), ("  ",), ("中国 90",)], "value string")
    words = segment.segmenter(segment.dictionary_of(segment.parse_dictionary(lines)))
    rows = spark.createDataFrame([("中国人民 abc",), (None,), ("",)], "x string").select(T.tokens("x", words).alias("t")).collect()
    assert rows[0].t == ["中国", "人民", "abc"] and rows[1].t == [] and rows[2].t == []
    with pytest.raises(ValueError, match="at most 2"):
        segment.dictionary_of(segment.parse_dictionary(lines), 2)


# ---- names


def spans_by_hand(text, names):
    used = []
    for name in sorted({n for n in names if n}, key=lambda n: (-len(n), n)):
        at = text.find(name)
        if at >= 0 and not any(at < b and a < at + len(name) for a, b, _ in used):
            used.append((at, at + len(name), name))
    return [n for _, _, n in sorted(used)]


def test_names_by_join(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts = ["".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    got = {r.text: r.entities for r in decompose.names_in(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"), spark.createDataFrame([(n,) for n in [*names, "", None]], "name string")).collect()}
    want = {t: spans_by_hand(t, names) for t in texts}
    assert got == {t: s for t, s in want.items() if s}


def test_many_names_and_repeated_queries(spark):
    names = spark.range(100_000).select(F.concat(F.lit("集团"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("号")).alias("name"))
    queries = spark.createDataFrame([(1, "集团000007号和集团099999号谁更高？"), (1, "集团000008号如何"), (2, "集团000007号和集团099999号谁更高？"), (3, None), (4, "总结集团000001号、集团000002号与集团000003号")], "query_id int, query string")
    rows = decompose.plan(queries, names).collect()
    kinds = sorted(((r.query_id, r.plan.query_type if r.plan else "") for r in rows))
    assert kinds == [(1, ""), (1, "compare"), (2, "compare"), (3, ""), (4, "summary")]
    assert next(r for r in rows if r.query_id == 2).plan.subqueries == ["集团000007号", "集团099999号"]


# ---- the matrix kernel


def test_exact_top_k_of_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(60, 3)), 1)
    rows = [(f"v{k:02}", list(map(float, v))) for k, v in enumerate(x)] + [("n", None), ("s", [1.0]), ("h", [None, 1.0, 2.0]), ("z", [0.0, 0.0, 0.0]), ("v00", list(map(float, x[0])))]
    df = spark.createDataFrame(rows, "id string, v array<double>").repartition(3)
    queries = spark.createDataFrame([(q, list(map(float, x[q]))) for q in range(0, 60, 7)] + [(100, None), (101, [0.0, 0.0, 0.0])], "query_id long, q array<double>")
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    whole = [(i, v) for i, v in rows if v is not None and len(v) == 3 and None not in v]
    monkeypatch.setattr(dense, "TOGETHER", 4)
    got = sorted((r.query_id, r["rank"], r.id, round(r.score, 5)) for r in dense.exact_top_k(df, queries, 6).collect())
    want = []
    for q, v in [(q, x[q]) for q in range(0, 60, 7)] + [(101, [0.0, 0.0, 0.0])]:
        best = sorted((-round(float(unit(v) @ unit(w)), 6), i) for i, w in whole)[:6]
        want += [(q, n + 1, i, round(-s, 5)) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert dense.exact_top_k(df.limit(0), queries, 6).count() == 0 and dense.exact_top_k(df, queries.limit(0), 6).count() == 0
    assert sorted((r.query_id, r.id) for r in dense.exact_top_k(df, queries, 6, block=3).collect()) == sorted((q, i) for q, _, i, _ in want)


def test_best_equals_scores(spark):
    rows = [(i, [None, "", "a b b", "a c d", "d", "e a a", "c c b"][i % 7]) for i in range(40)] + [(100 + i, f"a w{i} b w{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    asked = spark.createDataFrame([(i, ["a b d", "c", "w1 w2 a", "zz", "e e c b"][i % 5]) for i in range(9)], "query_id int, query string")
    tokens, terms = lexical.tokenized(docs, "doc_id", "text"), lexical.query_terms(asked, "query_id", "query")
    want = sorted(map(tuple, lexical.top_k(lexical.bm25_scores(tokens, terms), 6).collect()))
    assert len(want) > 30
    assert sorted(map(tuple, lexical.best(tokens, terms, 6).collect())) == want
    assert sorted(map(tuple, lexical.best(tokens, terms, 6, block=3).collect())) == want
    texts = lexical.best_of_texts(docs.toDF("id", "t"), asked.toDF("query_id", "t"), 6)
    assert sorted(map(tuple, texts.select("query_id", "rank", "id", "score").collect())) == want
    assert lexical.best(tokens.limit(0), terms, 6).count() == 0 and lexical.best(tokens, terms.limit(0), 6).count() == 0


def test_equal_texts_are_scored_once(spark, monkeypatch):
    seen = []
    best = lexical.best
    monkeypatch.setattr(lexical, "best", lambda docs, *a, **b: seen.append((docs.count(), docs.agg({"copies": "sum"}).first()[0])) or best(docs, *a, **b))
    rows = spark.range(300).selectExpr("id", "concat('a w', id % 3) AS t")
    found = lexical.best_of_texts(rows, rows.where("id % 50 = 0").toDF("query_id", "t"), 4).orderBy("query_id", "rank").collect()
    assert seen == [(3, 300)] and [r.id for r in found][:8] == [0, 3, 6, 9, 2, 5, 8, 11]


def test_names_of_ideographs_are_scored_once(spark, sf, monkeypatch):
    from quillspark.plans import registry

    registry.load()
    seen, best = [], lexical.best
    monkeypatch.setattr(lexical, "best", lambda docs, *a, **b: seen.append(docs.agg(F.count("*"), F.sum("copies")).first()) or best(docs, *a, **b))
    registry.QUERIES["bm25_ideographs"](spark, sf)
    parts = spark.read.parquet(f"{sf}/part.parquet")
    assert list(map(tuple, seen)) == [tuple(parts.agg(F.count_distinct("p_name"), F.count("*")).first())]


def test_best_hands_on_few_rows():
    import numpy as np
    import pyarrow as pa

    from quillspark.operators.best import Best

    rng, held, rows = np.random.default_rng(1), Best(30, 3), []
    for n in range(60):
        scores = np.round(rng.random((30, 200)), 2)
        rows += [(q, -scores[q, i], n * 200 + i) for q in range(30) for i in range(200)]
        held.add(np.arange(30), pa.array(range(n * 200, n * 200 + 200)), scores)
    got = [(q, i, s) for at, ids, scores in held.batches() for q, i, s in zip(at.tolist(), ids.to_pylist(), scores.tolist())]
    rows.sort()
    want = [(q, i, -s) for k, (q, s, i) in enumerate(rows) if k < 3 or rows[k - 3][0] != q]
    assert got == want


def test_inverted_lists_by_block(spark, monkeypatch):
    import numpy as np

    from quillspark.operators import dense

    rng = np.random.default_rng(3)
    x = [[round(float(c), 2) for c in v] for v in rng.normal(size=(300, 4))]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(900, None), (901, x[7]), (902, x[7])], "id int, v array<double>").repartition(5)
    cents = spark.createDataFrame([(i * 3, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(12, 4)))], "list_id int, c array<double>")
    asked = spark.createDataFrame([(i, x[i]) for i in range(0, 300, 20)], "query_id int, q array<double>")
    jobs = []
    in_blocks = dense.in_blocks
    monkeypatch.setattr(dense, "in_blocks", lambda queries, search, block: jobs.append(block) or in_blocks(queries, search, block))
    placed = {r.id: r.list_id for r in dense.assigned(rows, cents).collect()}
    probed = {(r.query_id, r.list_id) for r in dense.nearest_lists(asked, cents, 3, "query_id", "q").collect()}
    unit = {r.id: np.array(r.v) / np.linalg.norm(r.v) for r in rows.where("v IS NOT NULL").collect()}
    want = []
    for q in range(0, 300, 20):
        near = sorted((-round(float(unit[q] @ v), 6), i) for i, v in unit.items() if (q, placed[i]) in probed)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    for block in (None, 4):
        got = sorted(map(tuple, dense.ivf_top_k(rows, asked, cents, 5, 3, block=block).collect()))
        assert got == want
    assert jobs == [None, 4]  # probes don't divide the blocks


def test_best_by_groups_and_titles(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    words = ["a b b", "a c d", "d", "e a a", "c c b"]
    docs = spark.createDataFrame([(i, words[i % 5], ["b", "", "a d"][i % 3], None if i == 4 else f"s{i % 4}") for i in range(50)], "id int, t string, head string, group string").repartition(4)
    asked = spark.createDataFrame([(i, ["a b d", "c", "zz", "e e c b"][i % 4]) for i in range(7)], "query_id int, query string")
    terms = lexical.query_terms(asked, "query_id", "query")
    body, heads = lexical.tokenized(docs, "id", "t"), lexical.tokenized(docs, "id", "head")
    want = lexical.top_k(lexical.with_title_bonus(lexical.bm25_scores(body, terms), lexical.bm25_scores(heads, terms), 0.5), 6)
    both = lexical.tokenized(docs, "id", "t", also={"title": lexical.T.tokens("head"), "group": F.col("group")})
    assert sorted(map(tuple, lexical.best(both, terms, 6, title=0.5).collect())) == sorted(map(tuple, want.collect()))
    groups = spark.createDataFrame([(q, f"s{(q + b) % 6}") for q in range(7) for b in range(2)], "query_id int, group string")
    scores = lexical.bm25_scores(body, terms).join(docs.select("id", "group"), "id").join(groups, ["query_id", "group"]).withColumn("score", F.round("score", 4))
    w = Window.partitionBy("query_id", "group").orderBy(F.desc("score"), "id")
    want = scores.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("query_id", "group", "rank", "id", "score")
    got = lexical.best(both, terms, 3, groups=groups)
    assert want.count() > 10 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_units_are_counted_once(spark, monkeypatch):
    from quillspark.operators import chunking

    rows = [(d, "", "", i, 1, f"b{i}", f"One two{i} three. Four five! Six; " * 4) for d in range(3) for i in range(9)]
    units = spark.createDataFrame(rows, "doc_id int, section string, subsection string, ord int, page int, block_id string, text string")
    want = [(*r, size) for size in (10, 60, 200) for r in chunking.chunk_sections(units, size, 8).collect()]
    assert sorted(map(str, map(tuple, chunking.chunk_grid(units, (10, 60, 200), 8).collect()))) == sorted(map(str, want))
    read = []
    count = chunking.count_tokens
    monkeypatch.setattr(chunking, "count_tokens", lambda t: read.append(len(t)) or count(t))
    text = "alpha beta gamma; " * 400
    chunking.pack_units([(text, ["a"], 1), (text, ["b"], 1)], 1700, 10)
    assert sum(read) < 2.2 * len(text)  # each unit once and the tails
