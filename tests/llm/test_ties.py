"""Ties, repeated rows and missing policies of the earlier operators."""

import datetime

from quillspark.llm import licenses, pieces, urllists
from tests.llm.test_documents import tokenizer


def test_licence_files_of_one_folder(spark):
    """Equal scores go to the smallest doc_id, a higher score to its file, and repeated rows are each returned."""
    mit, apache = "MIT License", "Licensed under the Apache License, Version 2.0"
    rows = [(5, "a/LICENSE", mit), (3, "a/LICENSE.txt", apache), (9, "a/b/x.txt", "plain words"), (9, "a/b/x.txt", "plain words"), (7, "c/LICENSE", apache), (6, "c/LICENSE.txt", apache), (8, "c/y", ""), (None, "c/z", None), (4, None, mit)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = licenses.license_scan(df).collect()
    assert len(found) == len(rows)
    own = {r.doc_id: (r.license, round(r.score, 9)) for r in found if r.via == "header"}
    best = max((own[5][1], -5, own[5][0]), (own[3][1], -3, own[3][0]))
    assert [(r.license, r.levels, r.via) for r in found if r.doc_id == 9] == [(best[2], 1, "directory")] * 2
    assert own[7] == own[6] and {(r.license, r.via) for r in found if r.path in ("c/y", "c/z")} == {(own[6][0], "directory")}


def test_codec_of_repeated_rows(spark):
    path = tokenizer("piece_bpe_32k.model")
    rows = [(1, "aaaa bbbb aaaa"), (1, "aaaa bbbb aaaa"), (1, "other  text"), (None, "aaaa bbbb aaaa"), (2, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pieces.round_trip(df, path).collect()
    assert len(found) == 6 and all(r.same for r in found)
    assert sorted((str(r.doc_id), r.n_ids) for r in found) == sorted((str(i), len(x)) for i, x in ((r.doc_id, r.ids) for r in pieces.encode(df, path).collect()))
    assert len({(r.n_ids, r.ids_crc32) for r in found if r.n_ids}) == 2


def test_entries_without_a_policy(spark):
    """They count and name their list, and neither block nor allow."""
    day = datetime.date(2024, 1, 2)
    events = [("n", None, "domain", "x.example", "add", day), ("b", "block", "domain", "y.example", "add", day), ("n", None, "domain", "y.example", "add", day), ("odd", "other", "page", "z.example/p", "add", day)]
    urls = ["http://x.example", "http://a.y.example", "http://z.example/p"]
    captures = spark.createDataFrame([(k, u, day) for k, u in enumerate(urls)], "page_id long, url string, fetched_on date")
    rows = {r.page_id: (r.n_entries, r.lists, r.blocked) for r in urllists.match_lists(captures, spark.createDataFrame(events, urllists.EVENTS)).collect()}
    assert rows == {0: (1, "n", False), 1: (2, "b,n", True), 2: (1, "odd", False)}
