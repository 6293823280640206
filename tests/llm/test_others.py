"""Operators on vectors, pages and URLs against brute force, and their behaviour on odd rows."""

import base64
import datetime
import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import forest, maxscore, urllists, warc

VECTORS = "vec_id long, embedding array<float>, label int, score int, rank int, id int, v int"


def odd_vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], VECTORS)


def vectors(seed, n, dims=8, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for k in range(copies):
        x[n - 1 - k] = x[0] + 0.02 * rng.normal(size=dims)
    return [(k, [float(np.float32(c)) for c in row]) for k, row in enumerate(x)]


def test_top_k(spark):
    rows = vectors(1, 300) + [(7, [0.5] * 8), (400, [0.1] * 5), (401, None), (402, [float("nan")] * 8), (403, [None, 1.0]), (None, [1.0] * 8), (404, []), (405, [0.0] * 8), (406, [0.5] * 8)]
    rows = [r for r in rows if r != (7, rows[7][1])]
    df = odd_vectors(spark, rows)
    got = {}
    for r in maxscore.top_k(df, df.where("vec_id % 20 = 0 OR vec_id > 399"), 9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = {i: [int(np.floor(64 * c)) for c in v] for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    for i in (k for k in q if k % 20 == 0 or k > 399):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:9]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert maxscore.top_k(df, df.limit(0), 5).count() == 0 and maxscore.top_k(df.limit(0), df, 5).count() == 0


def test_top_k_with_few_or_negative_candidates(spark):
    df = odd_vectors(spark, [(0, [1.0, 1.0]), (1, [-1.0, -1.0]), (2, [-2.0, 0.0])])
    got = [(r["rank"], r.vec_id, r.score) for r in maxscore.top_k(df, df.where("vec_id = 0"), 20).orderBy("rank").collect()]
    assert got == [(1, 1, -8192), (2, 2, -8192)]


def exact_top(rows, asked, k):
    q = {i: [int(np.floor(64 * c)) for c in v] for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    clamp = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = []
    for i in (i for i in asked if i in q):
        best = sorted((-clamp(sum(a * b for a, b in zip(q[i], v))), j) for j, v in q.items() if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["sparse", "huge", "empty", "blocks"])
def test_top_k_of_odd_vectors(spark, kind, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(200, 12)) * (rng.random((200, 12)) < (0.1 if kind == "sparse" else 1.0))
    if kind == "huge":
        x[:4] *= 1e30
        x[40] *= 1e7
    rows = [(k, [] if kind == "empty" else list(map(float, r))) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = maxscore.top_k(df, df.where("vec_id % 20 = 0"), 7, block=3 if kind == "blocks" else maxscore.QUERY_BLOCK).collect()
    assert sorted(map(tuple, got)) == exact_top(rows, range(0, 200, 20), 7)


def test_shards_hand_their_floors_on():
    """Small shards, each with the k-th scores of those before it, and lists of few rows and of many."""
    rng = np.random.default_rng(14)
    x = np.floor(8 * rng.normal(size=(900, 10)) * (rng.random((900, 10)) < np.linspace(0.02, 1, 10)))
    best = [maxscore.Best(1, 5) for _ in range(9)]
    for at in range(0, 900, 100):
        shard = maxscore.Shard(np.arange(at, at + 100), x[at : at + 100])
        for n, b in enumerate(best):
            rows, scores = shard.search(n, x[n], b.floor(0))
            b.add(0, shard.ids[rows], scores)
    for n, b in enumerate(best):
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[n]) if j != n)[:5]
        assert [(-s, j) for j, s in zip(*map(np.ndarray.tolist, b.found[0]))] == want
    # a shard that can't reach the floor is skipped, and lists after the split are not traversed
    shard, seen = maxscore.Shard(np.arange(900), x), []
    shard.traverse = lambda q, lists: seen.append(len(lists)) or maxscore.Shard.traverse(shard, q, lists)
    assert len(shard.search(0, x[0], 1e9)[0]) == 0 and not seen
    shard.search(0, x[0], best[0].floor(0))
    assert seen and seen[0] < 10


@pytest.mark.parametrize("group", [8192, 128])
def test_forest(spark, group):
    rows = vectors(2, 900, copies=300)
    rows += [(1000, rows[0][1]), (1001, [2 * c for c in rows[0][1]]), (1002, None), (1003, [0.0] * 8), (1004, [float("inf")] * 8), (1005, [None] * 8), (None, rows[0][1]), (1006, [])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(odd_vectors(spark, rows), group=group).collect()}
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(usable))
    x = np.array([usable[i] / np.linalg.norm(usable[i]) for i in ids])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert sum(got[i][0] for i in ids) >= 0.9 * near.sum()
    assert all(got[i][0] <= n for i, n in zip(ids, near.sum(axis=1)))
    want = components(ids, near)
    assert np.mean([got[i][1] == want[i] for i in ids]) >= 0.9 and all(got[i][2] == (got[i][1] == i) for i in ids)
    assert got[899][1] == 0 and got[1000][1] == 0 and got[1001][1] == 0
    assert all(got[i] == (0, i, True) for i in (1002, 1003, 1004, 1005, 1006)) and got[None] == (0, None, True)
    assert forest.near_duplicates(odd_vectors(spark, [])).count() == 0


def components(ids, near):
    """The smallest id reachable from each."""
    label = ids.copy()
    for _ in range(len(ids)):
        new = np.array([min(label[k], label[r].min(initial=label[k])) for k, r in enumerate(near)])
        if (new == label).all():
            break
        label = new
    return dict(zip(ids.tolist(), label.tolist()))


def test_forest_in_double_precision(spark):
    """Doubles beyond the range and precision of floats link as they are."""
    edge = [1.0, float(np.sqrt(1 / 0.95**2 - 1))]  # a cosine of 0.95 with [1, 0], in doubles just about
    below, above = [1.0, edge[1] * (1 + 1e-10)], [1.0, edge[1] * (1 - 1e-10)]
    rows = [(1, [1e300, 0.0]), (2, [2e300, 0.0]), (3, [1.0, 0.0]), (4, below), (5, [1e-310, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}
    rows[3] = (4, above)
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {k: (4, 1) for k in range(1, 6)}


def b32(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_warc_round_trip(spark):
    html = ["<p>é</p>", "<p>é</p>", None, "", "x" * 300000, "a\r\n\r\nWARC/1.0\r\nb", "<p>é</p>"]
    rows = [(k, f"http://h/{k}\n", t) for k, t in enumerate(html)] + [(None, None, "only"), (9, None, "é\x00"), (9, None, "é\x00")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, d int")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect())
    last = {}
    for i, _, t in rows:
        if i is not None:
            last[t or ""] = max(i, last.get(t or "", i))
    want = []
    for i, _, t in rows:
        raw, to = (t or "").encode(), last.get(t or "")
        first = to is None or i == to
        want.append((str(i), len(raw), b32(raw), "response" if first else "revisit", None if first else to))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    some = warc.archive_round_trip(df, least_bytes=100).where("record_type = 'revisit'")
    assert some.count() == 0


def records(n):
    return [warc.record(f"body {k} {'z' * 50 * k}".encode(), {"WARC-Type": "response", "X-Page-Id": str(k), "WARC-Payload-Digest": "sha1:" + b32(f"body {k} {'z' * 50 * k}".encode())}) for k in range(n)]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    parts = [warc._gzip(r) if zipped else r for r in records(6)]
    whole = list(warc.salvage(io.BytesIO(b"".join(parts))))
    assert [h["x-page-id"] for _, _, s, h, _ in whole if s == "ok"] == list("012345") and all(s == "ok" for _, _, s, _, _ in whole)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    broken = bytearray(b"".join(parts))
    at = int(starts[2]) + len(parts[2]) // 2
    broken[at : at + 9] = b"\x00" * 9
    raw = b"junk" + bytes(broken[: starts[5] + 20])  # the last record is cut short
    found = list(warc.salvage(io.BytesIO(raw)))
    assert [h["x-page-id"] for _, _, s, h, _ in found if s == "ok"] == ["0", "1", "3", "4"]
    assert [(a, n) for a, n, s, _, _ in found if s == "gap"] == [(0, 4), (4 + starts[2], len(parts[2])), (4 + starts[5], 20)]
    assert list(warc.salvage(io.BytesIO(b""))) == [] and [s for _, _, s, _, _ in warc.salvage(io.BytesIO(b"nothing here"))] == ["gap"]


def test_salvage_inside_members():
    """A bad record of a member, a failed check and a member that breaks off cost what they hit, no more."""
    parts = records(6)
    ids = lambda raw: [h["x-page-id"] for _, _, s, h, _ in warc.salvage(io.BytesIO(raw)) if s == "ok"]
    gaps = lambda raw: [(a, n) for a, n, s, _, _ in warc.salvage(io.BytesIO(raw)) if s == "gap"]
    whole, other = warc._gzip(b"".join(parts)), warc._gzip(warc.record(b"", {"X-Page-Id": "next"}))
    assert ids(whole + other) == [*"012345", "next"] and gaps(whole + other) == []
    one_bad = warc._gzip(b"".join([*parts[:2], parts[2].replace(b"body", b"BODY"), *parts[3:]]))
    assert ids(one_bad + other) == [*"01345", "next"] and gaps(one_bad + other) == [(0, len(one_bad))]
    failed = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    assert ids(failed + other) == [*"012345", "next"] and gaps(failed + other) == [(0, len(failed))]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = stored.compress(b"".join(parts)) + stored.flush()
    cut = stored[: stored.index(b"body 4")]
    assert ids(cut) == [*"0123"] and gaps(cut) == [(0, len(cut))]
    broken = bytearray(stored)
    broken[stored.index(b"body 1") + 1] ^= 1
    assert ids(bytes(broken) + other) == [*"02345", "next"]


def test_salvage_of_an_absurd_length():
    """A claimed length beyond all bounds holds neither the archive nor the records after it back."""
    parts = records(5)
    wild = parts[1].replace(b"Content-Length: 57", b"Content-Length: 99999999999")
    assert wild != parts[1]
    filler = warc.record(b"y" * (3 << 20), {"WARC-Type": "response", "X-Page-Id": "long"})
    held = []

    class Stream(io.BytesIO):
        def read(self, n=-1):
            held.append(n)
            return super().read(n)

    found = list(warc.salvage(Stream(b"".join([parts[0], wild, *parts[2:], filler]))))
    assert [h["x-page-id"] for _, _, s, h, _ in found if s == "ok"] == ["0", "2", "3", "4", "long"] and max(held) < 8 << 20
    inner = warc.record(b"outer\r\n\r\nWARC/1.0 is no record", {"X-Page-Id": "in"})
    assert [h["x-page-id"] for _, _, s, h, _ in warc.salvage(io.BytesIO(inner + filler)) if s == "ok"] == ["in", "long"]
    assert [s for _, _, s, _, _ in warc.salvage(io.BytesIO(filler), most_bytes=1 << 20)] == ["gap"]


def test_salvage_of_other_versions():
    parts = [r.replace(b"WARC/1.0", b"WARC/0.18", 1) for r in records(4)]
    raw = b"".join([*parts[:1], parts[1].replace(b"body", b"BODY"), *parts[2:]])
    assert [h["x-page-id"] for _, _, s, h, _ in warc.salvage(io.BytesIO(b"junk" + raw)) if s == "ok"] == ["0", "2", "3"]


def test_read_warc_lists_files(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(records(2)) + b"tail")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.status for r in rows) == ["gap", "ok", "ok"] and {len(r.payload) for r in rows if r.payload} == {7, 57}


def day(n):
    return datetime.date(2024, 1, n)


def test_url_lists(spark):
    events = [("l", "block", "domain", "Bad.example", "add", day(2)), ("l", "block", "domain", "Bad.example", "remove", day(5)), ("l", "block", "domain", "Bad.example", "add", day(9)), ("l", "block", "domain", "Bad.example", "add", day(9)),
              ("w", "allow", "domain", "ok.bad.example", "add", day(1)), ("p", "block", "page", "h.example/a/", "add", day(3)), ("x", "block", "domain", "same.example", "add", day(4)), ("x", "block", "domain", "same.example", "remove", day(4)),
              (None, "block", "domain", "n.example", "add", day(1))]
    urls = [(1, "http://bad.example/x", day(1)), (2, "https://WWW.bad.example:80/x?q", day(2)), (3, "http://bad.example", day(4)), (4, "http://bad.example", day(5)), (5, "http://a.bad.example.", day(20)), (6, "http://ok.bad.example/", day(3)),
            (7, "http://h.example/a?x", day(3)), (8, "http://h.example/ab", day(3)), (9, "http://notbad.example", day(3)), (10, None, day(3)), (11, "no url", day(3)), (12, "http://bad.example", None), (13, "http://same.example", day(4)), (2, "https://WWW.bad.example:80/x?q", day(2)), (None, "http://bad.example", day(3))]
    captures = spark.createDataFrame([(*u, "x", 1) for u in urls], "page_id long, url string, fetched_on date, host string, n_entries int")
    listed = spark.createDataFrame(events, urllists.EVENTS)
    rows = urllists.match_lists(captures, listed).collect()
    assert len(rows) == len(urls)
    assert {r.page_id for r in rows if r.blocked} == {2, 3, 5, 7, None}
    assert {r.page_id: (r.n_entries, r.lists) for r in rows}[6] == (2, "l,w")
    assert urllists.match_lists(captures, listed.limit(0)).where("blocked OR n_entries > 0").count() == 0
    assert urllists.match_lists(captures.limit(0), listed).count() == 0
    assert urllists.keep_allowed(captures, listed).count() == len(urls) - sum(r.blocked for r in rows)


def test_page_entries_are_named_as_captures(spark):
    entries = ["https://H.example/a", "h.example/b?x=1", "http://u@h.example:80/c/#top", "h.example./d/", "HTTP://h.example"]
    listed = spark.createDataFrame([(f"l{k}", "block", "page", e, "add", day(1)) for k, e in enumerate(entries)], urllists.EVENTS)
    urls = ["http://h.example/a#top", "https://h.example/b", "http://h.example/c?y", "http://h.example/d", "https://h.example/?q", "http://h.example/e", "http://h.example/D"]
    captures = spark.createDataFrame([(k, u, day(2)) for k, u in enumerate(urls)], "page_id long, url string, fetched_on date")
    assert {r.page_id: r.lists for r in urllists.match_lists(captures, listed).collect()} == {0: "l0", 1: "l1", 2: "l2", 3: "l3", 4: "l4", 5: "", 6: ""}


def test_hosts_in_plan_are_matched_once(spark):
    captures = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("http://hot.example/x").alias("url"), F.lit(day(3)).alias("fetched_on"))
    listed = spark.createDataFrame([(f"l{k}", "block", "domain", "example", "add", day(1)) for k in range(20)], urllists.EVENTS)
    rows = urllists.match_lists(captures, listed)
    assert rows.count() == 1000 and rows.agg(F.min("n_entries")).first()[0] == 20
