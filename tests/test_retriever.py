import pytest
from pyspark.sql import functions as F

from quillspark.retriever import Retriever, Settings

CHUNKS = [("c1", "d1", "甲公司 revenue grew", "甲公司 report", [1.0, 0.0]), ("c2", "d1", "甲公司 margin", "甲公司 report", [0.9, 0.1]), ("c3", "d2", "乙公司 margin fell", "乙公司 report", [0.0, 1.0]), ("c4", "d3", "丙集团 margin flat", "other", [0.5, 0.5])]


@pytest.fixture(scope="module")
def retriever(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, text string, title string, v array<double>")
    names = spark.createDataFrame([("甲公司",), ("乙公司",), ("丙集团",)], "name string")
    return Retriever(chunks, Settings(top_k=3, candidates=4, title_weight=0.5), names)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "margin", [1.0, 0.0]), (2, "revenue", [0.0, 1.0])], "query_id int, query string, q array<double>")


def test_routes(retriever, queries):
    found = {(r.route, r.query_id, r["rank"]): r.id for r in retriever.search_all(queries).collect()}
    assert found["vector", 1, 1] == "c1" and found["vector", 2, 1] == "c3" and found["bm25", 2, 1] == "c1"
    # k is for the plain routes; fused ones return their first stage
    assert ("bm25", 1, 3) in found and ("vector", 1, 4) not in found and ("hybrid_weightsum", 1, 4) in found
    assert retriever.search(queries, "hybrid_rrf").where("query_id = 1").count() == 3
    with pytest.raises(ValueError, match="route"):
        retriever.search(queries, "graph")


def test_two_stage(retriever, queries):
    rows = retriever.two_stage(queries, route="vector", first=4, k=2).where("query_id = 1").orderBy("rank").collect()
    assert [r.id for r in rows] == ["c2", "c4"] and rows[0].rerank_score == 1.0
    other = retriever.two_stage(queries, F.length("text").cast("double"), route="vector", first=4, k=1).where("query_id = 1").first()
    assert other.id in ("c1", "c3", "c4")


def test_decomposed(retriever, spark):
    asked = spark.createDataFrame([(1, "甲公司和乙公司相比，margin谁更高？"), (2, "margin")], "query_id int, query string")
    rows = retriever.search_decomposed(asked).collect()
    assert {r.query_type for r in rows if r.query_id == 1} == {"compare"} and {"c2", "c3"} <= {r.id for r in rows if r.query_id == 1}
    assert {r.query_type for r in rows if r.query_id == 2} == {"fact"}


def test_words_of_ideographs_are_found(retriever, spark):
    """Runs of ideographs are segmented in the corpus and in queries alike; without a segmenter a run is one term."""
    chunks = spark.createDataFrame([("a", "x", "公司毛利率上升"), ("b", "y", "净利润下降"), ("c", "z", "其他内容")], "chunk_id string, doc_id string, text string")
    asked = spark.createDataFrame([("q#1", "毛利率")], "query_id string, query string")
    assert [(r.query_id, r.id) for r in Retriever(chunks).search(asked, "bm25").collect()] == [("q#1", "a")]
    assert Retriever(chunks, segment=None).search(asked, "bm25").count() == 0


def test_plain_queries_are_searched_plainly(spark):
    """The cap of hits per document, and a plan's sizes, are for branches only."""
    rows = [(f"c{k}", "d1", f"margin {k}") for k in range(6)] + [(f"a{k}", "d2", "甲公司 margin") for k in range(4)] + [(f"b{k}", f"e{k}", "乙公司 margin") for k in range(9)]
    names = spark.createDataFrame([("甲公司",), ("乙公司",)], "name string")
    r = Retriever(spark.createDataFrame(rows, "chunk_id string, doc_id string, text string"), Settings(top_k=10, title_weight=0.0), names)
    asked = spark.createDataFrame([("x#0", "margin"), ("y", "甲公司和乙公司相比，margin谁更高？")], "query_id string, query string")
    hits = r.search_decomposed(asked).collect()
    plain = {h.id for h in r.search(asked.where("query_id = 'x#0'"), "bm25").collect()}
    assert {h.id for h in hits if h.query_id == "x#0"} == plain and len(plain) == 10
    branches = [h for h in hits if h.query_id == "y"]
    assert sum(h.doc_id == "d2" for h in branches) <= 4 and {h.query_type for h in branches} == {"compare"}
    staged = r.two_stage(asked, route="bm25", decomposed=True, k=4)
    assert staged.groupBy("query_id").count().where("count = 4").count() == 2
    assert [p.branch_candidate_k for p in r.plans(asked).select("plan.branch_candidate_k").collect()] == [None, 25]


def test_branches_have_their_own_vectors(spark):
    rows = [("a", "d1", "甲公司", [1.0, 0.0]), ("b", "d2", "乙公司", [0.0, 1.0]), ("c", "d3", "x", [0.7, 0.7])]
    names = spark.createDataFrame([("甲公司",), ("乙公司",)], "name string")
    r = Retriever(spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, v array<double>"), Settings(top_k=2), names)
    asked = spark.createDataFrame([(1, "甲公司和乙公司，谁更高", [0.7, 0.7], [[1.0, 0.0], [0.0, 1.0]])], "query_id int, query string, q array<double>, branch_q array<array<double>>")
    # a chunk of several branches counts in the first: c by 甲公司's vector
    assert {h.id: round(h.score, 3) for h in r.search_decomposed(asked, "vector").collect()} == {"a": 1.0, "c": 0.707}


def test_titles_are_the_first_of_their_document(spark):
    rows = [("c2", "d", 1, "body", "second", "Acme"), ("c1", "d", 0, "body", "", "")]
    r = Retriever(spark.createDataFrame(rows, "chunk_id string, doc_id string, ord int, text string, title string, company string"), Settings(title_weight=1.0))
    assert [x.tokens for x in r.heads.collect()] == [["second", "acme"]]
