"""Vectors by content, answers with errors, listings of files, answers on disk and written sessions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import evaluate
from quillspark.operators import answers, embedding
from quillspark.retriever import Retriever, Settings
from quillspark.sources import readers, writers


def counting(path):
    """An encoder that notes what it was asked."""

    def load():
        def encode(texts):
            with open(path, "a") as f:
                f.write("".join(json.dumps(t) + "\n" for t in texts))
            return np.array([[len(t), t.count("a")] for t in texts])

        return encode

    return load


def test_only_what_changed_is_encoded(spark, tmp_path):
    log = tmp_path / "log"
    rows = lambda *t: spark.createDataFrame([(k, x) for k, x in enumerate(t)], "id int, text string")
    store = embedding.EmbeddingStore(spark, str(tmp_path / "store"), "count", counting(str(log)))
    assert store.add(rows("aa", "b", "aa", None, "")) == 3 and sorted(map(json.loads, log.read_text().split())) == ["", "aa", "b"]
    log.write_text("")
    assert store.add(rows("aa", "cab", "b", "ada"), block=1) == 2 and sorted(map(json.loads, log.read_text().split())) == ["ada", "cab"]
    got = {r.id: None if r.v is None else list(r.v) for r in store.vectors(rows("aa", "cab", None, "new")).collect()}
    assert got == {0: [2.0, 2.0], 1: [3.0, 1.0], 2: [0.0, 0.0], 3: None}
    # a block that broke off doesn't count, and another encoder's store is another
    for block in (tmp_path / "store/encoder=count").iterdir():
        (block / "_SUCCESS").unlink()
    assert store.add(rows("aa", "b", "", "cab", "ada")) == 5 and store.add(rows("aa", "b", "", "cab", "ada")) == 0
    assert embedding.EmbeddingStore(spark, str(tmp_path / "store"), "other", counting(str(log))).stored().count() == 0
    assert store.embedded(rows("zz")).first().v == [2.0, 0.0] and store.add(rows("zz").limit(0)) == 0


def test_hashed_words():
    encode = embedding.hashed_words(16)()
    x = encode(["red fox", "fox RED", "红狐狸", ""])
    assert (x[0] == x[1]).all() and x[2].any() and not x[3].any()


def test_answers_with_an_error_each(spark):
    def load():
        def model(prompt):
            if prompt is None or "bad" in prompt:
                raise ValueError(f"no answer to {prompt}")
            return prompt.upper()

        return model

    def broken():
        raise OSError("no model")

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "d")], "qid int, prompt string")
    got = {r.qid: (r.answer, r.error) for r in evaluate.generated(df, load).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no answer to bad"), 3: (None, "ValueError: no answer to None"), 4: ("D", None)}
    assert {r.error for r in evaluate.generated(df, broken).collect()} == {"OSError: no model"}
    assert evaluate.generated(df.limit(0), load).count() == 0


def test_answers_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"a": 1}')], "query_id int, payload string")
    writers.write_answers(df, str(tmp_path / "out"), meta={"model": "m", "top_k": 5})
    with pytest.raises(Exception, match="exists|EXISTS"):
        writers.write_answers(df, str(tmp_path / "out"))
    writers.append_answers(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/records")).count() == 2 and spark.read.json(str(tmp_path / "out/run")).first().top_k == 5
    writers.write_answers(df, str(tmp_path / "out"), overwrite=True)
    assert spark.read.json(str(tmp_path / "out/records")).count() == 1


def test_files_are_listed_once(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for name in ("a/x.parsed.json", "a/b/y.parsed.json"):
        (tmp_path / name).write_text(json.dumps({"blocks": [{"id": "1", "text": "t"}]}))
    at = str(tmp_path)
    docs = readers.parsed_documents(spark, [at, f"{at}/a", f"{at}/a/b/", f"{at}/a/x.parsed.json", f"{at}/a/*.json"])
    assert sorted(r.doc_id for r in docs.collect()) == ["x", "y"] and "Exchange" not in docs._jdf.queryExecution().toString()
    assert [p.rpartition("/")[2] for p in readers.disjoint(spark, [f"{at}/a/b", f"{at}/a/x.parsed.json"])] == ["b", "x.parsed.json"]
    writers.write_parsed(spark.createDataFrame([("d", "s", [("1", "text", "t")])], "doc_id string, source string, blocks array<struct<id string, type string, text string>>"), f"{at}/p")
    assert spark.read.json(f"{at}/p").select("doc_id", F.explode("blocks").alias("b")).first().b.text == "t"


def test_rounds_are_written(spark):
    asked = []

    def search(queries):
        asked.append(queries.count())
        return queries.select("query_id", F.lit(1).alias("rank"), F.lit("c").alias("id"), F.lit(9.0).alias("score"), F.concat(F.lit("Text of "), "query", F.lit("。")).alias("text"))

    turns = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    session = answers.Session(turns, search, rounds=4)
    for k in range(3):
        session.ask(spark.createDataFrame([(1, f"q{k}"), (2, f"p{k}")], "query_id int, query string")).collect()
    rows = session.turns.where("conv_id = 1").orderBy("turn").collect()
    assert [(r.turn, r.role) for r in rows] == [(k + 1, "user" if k % 2 == 0 else "assistant") for k in range(6)] and rows[4].text == "q2"
    assert len(asked) == 3 and session.turns._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_an_index_with_its_build(spark, tmp_path):
    (made, seconds) = evaluate.timed_build(lambda: spark.range(10).write.parquet(str(tmp_path / "ix")))
    queries = spark.createDataFrame([(1, [1.0])], "query_id int, q array<double>")
    hits = spark.createDataFrame([(1, 1, 5, 1.0)], "query_id int, rank int, id int, score double")
    found = evaluate.index_comparison({"a": lambda q, k: hits, "b": lambda q, k: hits}, queries, hits, 1, 1, {"a": (seconds, str(tmp_path / "ix"))})
    assert found[0]["build_s"] == seconds and found[0]["mb"] > 0 and found[1]["mb"] is None


def test_a_retriever_deletes_its_tables(spark):
    chunks = spark.createDataFrame([("c1", "d", "red fox"), ("c2", "d", None), ("c3", "e", "blue whale whale"), *((f"z{k}", "f", "else") for k in range(4))], "chunk_id string, doc_id string, text string")
    r = Retriever(chunks, Settings(top_k=2))
    queries = spark.createDataFrame([(1, "whale"), (2, "fox")], "query_id int, query string")
    assert {x.query_id: x.id for x in r.search(queries, "bm25").collect()} == {1: "c3", 2: "c1"} and r.warm_up() == 7
    files = r.docs.inputFiles()
    r.close()
    import os

    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
