"""Parsed documents, chunk files and JSON lines as data sources: batch, stream, choice by path."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.sources import json_source, readers


@pytest.fixture(scope="module")
def known(spark):
    return json_source.register(spark)


def _parsed(folder, name, source, texts, age=60):
    folder.mkdir(parents=True, exist_ok=True)
    blocks = [{"id": f"b{k}", "type": "text", "page": 1, "bbox": [1, 2.5, 3, 4], "text": t, "meta": {"level": "2"}} for k, t in enumerate(texts)]
    path = folder / f"{name}.parsed.json"
    path.write_text(json.dumps({"source": source, "page_sizes": [{"page": 1, "width": 600, "height": 800.5}], "blocks": blocks}, ensure_ascii=False))
    os.utime(path, (time.time() - age,) * 2)


def _plain(rows, columns):
    return sorted((str(r) for r in rows.select(*columns).collect()))


def test_equals_the_plain_reader_without_a_shuffle(known, tmp_path):
    _parsed(tmp_path / "a", "x", "/in/Report.PDF", ["甲", None, ""])
    _parsed(tmp_path / "a" / "deep", "y", None, [])
    (tmp_path / "a" / "_hidden.parsed.json").write_text("{")
    (tmp_path / "a" / "other.json").write_text("{}")
    paths = [str(tmp_path / "a"), str(tmp_path / "a" / "deep")]
    got = known.read.format("parsed_documents").load(paths)
    columns = ["doc_id", "source", "page_sizes", "blocks"]
    assert _plain(got, columns) == _plain(readers.parsed_documents(known, [str(tmp_path / "a" / n) for n in ("x.parsed.json", "deep")]), columns)
    assert sorted(r.doc_id for r in got.collect()) == ["Report", "y"]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_files_are_chosen_by_path(known, tmp_path):
    _parsed(tmp_path / "2023", "x", "x.pdf", ["a"])
    _parsed(tmp_path / "2024", "y", "y.pdf", ["b"])
    (tmp_path / "2023" / "bad.parsed.json").write_text("{")
    # the malformed file is not opened
    only = known.read.format("parsed_documents").option("only", r"/2024/|/x\.").load(str(tmp_path))
    assert sorted(r.doc_id for r in only.collect()) == ["x", "y"]
    # conditions of one query change nothing for the next on the same DataFrame
    assert [r.doc_id for r in only.where(F.col("path").contains("/2024/")).collect()] == ["y"]
    assert [r.doc_id for r in only.where(F.col("path") == f"file://{tmp_path}/2023/x.parsed.json").collect()] == ["x"] and only.count() == 2
    rows = known.read.format("parsed_documents").load(str(tmp_path))
    with pytest.raises(Exception, match="malformed JSON"):
        rows.collect()
    assert known.read.format("parsed_documents").option("malformed", "skip").load(str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="nowhere"):
        known.read.format("parsed_documents").load(str(tmp_path / "nowhere")).collect()


def test_chunks_and_lines_from_sql(known, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"chunks": [{"id": "c1", "text": None, "metadata": {"page_start": 3, "block_ids": ["b"]}}, None, {"id": 7, "text": "t"}]}))
    (tmp_path / "none.json").write_text("{}")
    got = known.read.format("chunk_files").load(str(tmp_path))
    columns = ["doc_id", "source", "ord", "chunk_id", "text", "metadata"]
    assert _plain(got, columns) == _plain(readers.chunk_files(known, str(tmp_path)), columns) and got.count() == 2
    (tmp_path / "log.jsonl").write_text('{"qid": "1", "metrics": {"r": 0.5}}\n\n{"qid": \n[]\n{"qid": "2"}\n')
    known.sql(f"CREATE OR REPLACE TEMPORARY VIEW done USING json_lines OPTIONS (path '{tmp_path}', malformed 'skip')")
    found = known.sql("SELECT line, from_json(record, 'qid string, metrics map<string,double>') AS r FROM done ORDER BY line").collect()
    assert [(x.line, x.r.qid, x.r.metrics) for x in found] == [(0, "1", {"r": 0.5}), (4, "2", None)]
    with pytest.raises(Exception, match="line 3"):
        known.read.format("json_lines").load(str(tmp_path)).collect()


def test_small_files_share_partitions():
    files = [json_source.File(f"f{k}", k, size) for k, size in enumerate((10, 10, 5 << 20, 10))]
    parts = json_source.shared_out(files, 3 << 20)
    assert [[f.path for f in p.held] for p in parts] == [["f0", "f1"], ["f2"], ["f3"]] and json_source.shared_out([], 1) == []


def test_values_that_do_not_fit(known):
    kind = StructType.fromDDL("source string, sizes array<struct<page:int,width:double>>, blocks array<string>, meta map<string,string>")
    doc = json_source._typed({"source": 5, "sizes": [{"page": 2**40, "width": True}, 3], "blocks": "no", "meta": {"a": [1]}}, kind)
    assert doc == {"source": "5", "sizes": [{"page": None, "width": None}, None], "blocks": None, "meta": [("a", "[1]")]}


def test_stream_equals_batch_after_restarts(known, tmp_path):
    held, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    known.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")

    def advance():
        rows = known.readStream.format("parsed_documents").option("settleSeconds", "5").load(str(held)).select("path", "doc_id", "blocks")
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()

    seen = lambda: sorted(r.doc_id for r in known.read.parquet(out).collect())
    _parsed(held, "a", "a.pdf", ["1"], age=300)
    _parsed(held, "b", "b.pdf", ["2"], age=300)
    advance()
    assert seen() == ["a", "b"]
    _parsed(held / "deep", "c", "c.pdf", ["3"], age=200)
    _parsed(held, "young", "young.pdf", ["4"], age=-60)
    advance()
    assert seen() == ["a", "b", "c"]
    advance()
    assert seen() == ["a", "b", "c"]
    os.utime(held / "young.parsed.json", (time.time() - 100,) * 2)
    advance()
    batch = known.read.format("parsed_documents").load(str(held))
    columns = ["path", "doc_id", "blocks"]
    assert _plain(known.read.parquet(out), columns) == _plain(batch, columns) and len(seen()) == 4
    # a file that is changed comes again
    _parsed(held, "a", "a.pdf", ["1", "more"], age=50)
    advance()
    assert seen() == ["a", "a", "b", "c", "young"]
