"""The stages of the corpus pipeline, each against brute force on its own input, and on odd rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import quality
from tests.llm.test_documents import LOWER, components_of, edited, shingles, tokenizer

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, reason int, h int, component int, removed int, span int"
EXTRA = (1, 2, 3, 4, 5)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *EXTRA) for i, t in rows], DOCUMENTS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels of the test tables, and documents: theirs, near copies, repeats, and odd rows."""
    path = tmp_path_factory.mktemp("sf")
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(21)
    rows = [(r.doc_id, r.text) for r in given.where("doc_id < 60").collect()]
    prose = [t for _, t in rows if t and len(t.split()) > 120][:3]
    passage = " ".join(f"p{x}" for x in rng.integers(0, 3000, 70))
    rows += [(1000 + k, t) for k, t in enumerate(edited(rng, 90)[:4])]
    rows += [(1100 + k, f"{t} and {passage} then {' '.join(t.split()[:5])}.") for k, t in enumerate(prose)]
    rows += [(None, prose[0]), (1200, None), (1201, ""), (1202, "the " * 9000), (rows[0][0], rows[1][1])]
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    return f"{path}"


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The input and the result of every stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = corpus_pipeline.materialize(stage(spark, docs, folder), "test")
        out.append((docs, result))
        docs = result
    return out


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_quality_stage_keeps_what_the_classifier_accepts(spark, folder, stages):
    docs, out = stages[0]
    assert out.columns == docs.columns
    model = quality.fit(*quality.training_rows(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), "quality"))
    held = docs.collect()
    keep = model.score(quality.statistics([r.text for r in held])) >= 0.5
    assert rows_of(out) == sorted(str(r) for r, k in zip(held, keep) if k)


def test_near_copies_stage_keeps_one_of_each_group(stages):
    docs, out = stages[1]
    held = docs.collect()
    texts = {}
    for r in held:
        if r.doc_id is not None:
            texts.setdefault(r.doc_id, []).append(shingles(r.text))
    flat = [(i, s) for i, sets in texts.items() for s in sets if s]
    links = [(a, b) for k, (a, s) in enumerate(flat) for b, t in flat[:k] if 100 * len(s & t) >= 75 * len(s | t)]
    least = components_of(texts, links)
    assert rows_of(out) == sorted(str(r) for r in held if r.doc_id is None or least[r.doc_id] == r.doc_id)


def test_passages_stage_leaves_no_long_repeat(stages):
    docs, out = stages[2]
    assert out.columns == docs.columns and out.count() == docs.count()
    before = {(r.doc_id, r.text) for r in docs.collect()}
    after = out.collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    assert {r.doc_id for r in after} == {i for i, _ in before}
    seen = {}
    for r in sorted((r for r in after if r.doc_id is not None), key=lambda r: r.doc_id):
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER))
        for k in range(len(w) - 50):
            window = tuple(w[k : k + 51])
            if len(set(window)) >= 10:
                assert seen.setdefault(window, r.doc_id) == r.doc_id
    once = {i for i, _ in before if sum(j == i for j, _ in before) == 1}
    whole = {i: t for i, t in before if i in once}
    cut = [r for r in after if r.doc_id in once and r.text != whole[r.doc_id]]
    assert cut
    # what is left stands in the text in order
    for r in cut:
        at = 0
        for word in (r.text or "").split():
            at = whole[r.doc_id].index(word, at)


def test_packing_stage_holds_every_token(stages):
    from tokenizers import Tokenizer

    docs, out = stages[3]
    plain = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = out.select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    filled = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert filled.where("n > 2048 OR n != end").count() == 0


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
