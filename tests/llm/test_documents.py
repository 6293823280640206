"""Operators on documents against brute force, and their behaviour on odd rows."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.llm import jaccard, licenses, packing, passages, pieces, pigeonhole, quality, words
from quillspark.llm.components import connected_components
from quillspark.llm.tokens import WordTokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, h int, a int, group int, removed int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenizer(name):
    import public_tokenizers

    return str(public_tokenizers.path(name))


def odd_documents(spark, rows):
    """Rows (doc_id, text) with other columns, some named as an operator names its own."""
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def edited(rng, n, vocabulary=4000):
    """A text of n words and versions of it with more and more words changed."""
    base = [f"w{x}" for x in rng.integers(0, vocabulary, n)]
    out = []
    for k in range(0, max(2, n // 12)):
        w = list(base)
        for at in rng.integers(0, n, k):
            w[at] = f"x{rng.integers(0, 1 << 30)}"
        out.append(" ".join(w))
    return out


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t", max_size=40), st.text(max_size=20)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_shingle_sets(texts):
    got = {}
    for first, after, offsets, h in words.shingle_sets(texts):
        for i in range(after - first):
            got[first + i] = set(h[offsets[i] : offsets[i + 1]].tolist())
    assert [len(got.get(i, ())) for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    for i, s in enumerate(texts):
        for j, t in enumerate(texts):
            assert len(got[i] & got[j]) == len(shingles(s) & shingles(t))


def test_signatures_lose_no_pair():
    """Any two sets of 3/4 and above share a signature that one of them probes."""
    rng = np.random.default_rng(5)
    sets, pairs = [], []
    for n in [*range(1, 60), 80, 130, 250, 600]:
        base = rng.integers(0, 1 << 62, n).astype(np.uint64)
        for k in range(0, n // 4 + 1, max(1, n // 12)):
            for add in (0, k):
                other = np.unique(np.concatenate((base[k:], rng.integers(0, 1 << 62, add).astype(np.uint64))))
                both = len(np.intersect1d(base, other))
                if len(other) and 100 * both >= 75 * (len(np.unique(base)) + len(other) - both):
                    pairs.append((len(sets), len(sets) + 1))
                    sets += [np.unique(base), other]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    often = np.sort(np.concatenate([s[: len(s) // 2] for s in sets[::7]]))
    for frequent, classes in ((np.empty(0, np.uint64), np.empty(0, np.uint8)), (often, np.full(len(often), 5, np.uint8))):
        doc, sig, flag = pigeonhole.signatures(offsets, np.concatenate(sets), frequent, classes)
        by = defaultdict(list)
        for d, s, f in zip(doc.tolist(), sig.tolist(), flag.tolist()):
            by[d].append((s, f))
        for a, b in pairs:
            probes = {s for s, f in by[a] if f & 2} & {s for s, f in by[b]} | {s for s, f in by[b] if f & 2} & {s for s, f in by[a]}
            assert probes, (len(sets[a]), len(sets[b]))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), min_size=1, max_size=80), st.sets(st.integers(0, (1 << 64) - 1), min_size=1, max_size=80))
def test_sketch_bound(a, b):
    a |= set(list(b)[: len(b) // 2])
    x, y = (jaccard.sketch(np.array(sorted(s), np.uint64)) for s in (a, b))
    assert jaccard.least_apart(x, y) <= len(a ^ b)


def test_jaccard_components(spark):
    rng = np.random.default_rng(1)
    rows = [(100 + k, t) for k, t in enumerate(t for n in (3, 5, 6, 9, 20, 40, 90, 200) for t in edited(rng, n))]
    rows += [(5, rows[-1][1]), (6, rows[-1][1].upper()), (1, None), (2, ""), (3, " \n"), (None, rows[0][1]), (7, "one two"), (8, "One  two"), (9, "a " * 3000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd_documents(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert got.pop(None) == (len(shingles(rows[0][1])), None)
    assert got == {i: (len(sets[i]), c) for i, c in components_of(sets, links).items()}
    assert jaccard.jaccard_components(odd_documents(spark, [])).count() == 0


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in range(60)]
    rows = []
    for k in range(1500):
        w = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            w[at] = f"x{rng.integers(0, 50)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(odd_documents(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    kinds = {s: min(i for i in sets if sets[i] == s) for s in set(sets.values())}
    keys = list(kinds)
    links = [(kinds[s], kinds[t]) for n, s in enumerate(keys) for t in keys[:n] if 100 * len(s & t) >= 75 * len(s | t)]
    want = components_of(kinds.values(), links)
    assert got == {i: want[kinds[s]] for i, s in sets.items()}


def test_keep_one_keeps_columns(spark):
    df = odd_documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b c d e f")])
    out = jaccard.keep_one(df)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None"]


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (50, 2))] + [(k, k + 1) for k in range(100, 140)] + [(None, 3), (4, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None]
    want = components_of({n for e in real for n in e}, real)
    assert got == {n: c for n, c in want.items() if n != c}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_is_proven(lengths):
    """The bound never exceeds the best packing, found by trying all."""
    counts = np.bincount(lengths, minlength=21) if lengths else np.zeros(21, int)
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= 20:
                place(k + 1, [*bins[:b], bins[b] + lengths[k], *bins[b + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    lengths.sort(reverse=True)
    place(0, [])
    bound = packing.dff_bound(counts, 20)
    assert bound <= best and (not lengths or bound >= 1)
    if lengths:
        bins, offsets = packing.best_fit_decreasing(np.array(lengths), 20)
        assert np.bincount(bins, weights=lengths).max() <= 20 and bins.max() + 1 >= best


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"word{x}" for x in rng.integers(0, 99, rng.integers(0, 300)))) for k in range(200)]
    rows += [(500, None), (501, ""), (502, "long " * 9000), (None, "x"), (500, "again")]
    got = packing.pack_documents(odd_documents(spark, rows), path, per_task=40).toPandas()
    want = []
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = lambda rows: sorted((str(a if a is None or a != a else int(a)).replace("nan", "None"), *map(int, r)) for a, *r in rows)
    assert key(got[cols].itertuples(index=False)) == key(want)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.length.sum() <= 2048 and (part.length.cumsum() - part.length == part.offset).all()
    bound = packing.dff_bound(np.bincount(got.length, minlength=2049), 2048)
    assert got.sequence_id.nunique() <= bound + 1
    assert packing.pack_documents(odd_documents(spark, []), path).count() == 0


@pytest.mark.parametrize("bad", ["first", "later"])
def test_packing_rounds(spark, monkeypatch, bad):
    """A round that gains nothing is undone; one that opens all its sequences is followed by another."""
    real = packing._pack_group

    def pack(capacity, round_no):
        run = real(capacity, round_no)

        def alone(key, df):
            out = run(key, df)
            out["sequence_id"], out["offset"], out["open"] = (round_no << 56) + (key[0] << 28) + np.arange(len(out)), 0, round_no == 0
            return out

        return alone if (round_no == 0) == (bad == "first") else run

    monkeypatch.setattr(packing, "_pack_group", pack)
    rng = np.random.default_rng(12)
    rows = spark.createDataFrame([(k, int(n)) for k, n in enumerate(rng.integers(3, 15, 200))], "doc_id long, length long")
    got = packing.pack_pieces(rows, 20, per_task=40).toPandas()
    assert sorted(got.doc_id) == list(range(200)) and got.groupby("sequence_id").length.sum().max() <= 20
    if bad == "first":
        assert got.sequence_id.nunique() < 150
    else:
        assert (got.sequence_id < 1 << 56).all()


def test_word_tokenizer_equals_library(sf):
    import pyarrow.parquet as pq

    t = WordTokenizer(tokenizer("word_bpe_49k.json"), cache_words=2000)
    texts = [*pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:60], "ΑΣ Σ İx ﬁ ①² ½ª", "don't I'LL <|endoftext|> x<|startoftext|>y", "á \xa0 b\x1cc  d 中文 😀", "", None, " \n"]
    for text, ids in zip(texts, t.encode(texts)):
        assert ids.tolist() == t.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_library(spark, sf):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(4)
    letters = list("abcdeéñ中文😀 \n\t  .,!?thionsr▁")
    rows = [(k, "".join(rng.choice(letters, rng.integers(0, 40)))) for k in range(400)] + [(900, None), (901, ""), (None, "a  b"), (902, "the " * 9000), (903, " " * 50)]
    encoded = pieces.encode(odd_documents(spark, rows), path)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: lib.encode(t or "") for i, t in rows}
    back = {r.doc_id: r.text for r in pieces.decode(encoded, path).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)
    assert pieces.round_trip(odd_documents(spark, []), path).count() == 0


def test_unigram_equals_library():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40000.0)
    raw = proto.SerializeToString()
    mine, lib = pieces.PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    rng = np.random.default_rng(6)
    for _ in range(300):
        t = "".join(rng.choice(list("thionsraeé中😀 ▁.,"), rng.integers(0, 40)))
        assert mine.encode(t).tolist() == lib.encode(t)


def test_statistics_of_odd_texts():
    x = quality.statistics([None, "", " \n\t", "a", "Hello World! 12 |", "é" * 5000, "x " * 70000])
    assert x.shape == (7, len(quality.FEATURES)) and np.isfinite(x).all() and (x[0] == x[1]).all()
    one = quality.statistics(["Hello World! 12 |"])[0]
    assert (one == x[4]).all()  # whatever stands beside it
    f = dict(zip(quality.FEATURES, x[4]))
    assert f["digits"] == pytest.approx(2 / 17) and f["pipes"] == pytest.approx(1 / 17) and f["mean_word"] == pytest.approx(14 / 4)


def test_trees_equal_a_walk():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 6))
    y = (x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit(x, y, trees=30, depth=3)
    score = model.score(x)
    for k in range(0, 500, 50):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + (f[node] >= 0 and x[k, f[node]] > t[node])
            total += v[node - 7]
        assert score[k] == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((score >= 0.5) == y).mean() > 0.9
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95
    docs = odd_documents(spark, [(None, None), (1, ""), (1, "x")])
    rows = quality.classify(docs, labels.limit(0)).collect()
    assert len(rows) == 3 and all(r.score == 0.5 for r in rows)
    assert {r.doc_id: r.held_out for r in rows}[1] == (zlib.crc32(b"1") % 3 == 1)
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_training_rows_of_repeated_ids(spark):
    """Whatever the order of the rows, one text of each doc_id teaches, and a row per doc_id reaches the driver."""
    texts = ["short", "a longer text with more words.", "UPPER! CASE!", ""]
    rows = [(k % 5, texts[k % 4]) for k in range(200)] + [(None, "x"), (7, None)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)] + [(3, 1, 0), (4, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    found = [quality.training_rows(odd_documents(spark, r), labels, "quality", None) for r in (rows, rows[::-1])]
    assert (found[0][0] == found[1][0]).all() and found[0][1].tolist() == found[1][1].tolist() == [0.0, 1.0, 0.0, 1.0, 1.0]


def passage(rng, n, tag):
    w = [f"{tag}{x}" for x in rng.integers(0, 3000, n)]
    return " ".join(" ".join(w[k : k + 10]) + "." for k in range(0, n, 10))


def test_substring_dedup(spark):
    rng = np.random.default_rng(8)
    shared, short = passage(rng, 60, "p"), passage(rng, 20, "q")
    near = shared.replace(shared.split()[5], "changed")
    clean = {k: passage(rng, 80, f"c{k}x") for k in range(6)}
    rows = [(1, f"{clean[1]} {shared} {clean[2]}"), (2, f"{clean[3]}\n{shared}"), (3, f"{short} {clean[4]}"), (4, f"{short} {clean[5]}"), (5, shared), (6, near), (7, f"{clean[0]} {shared} {shared}"),
            (None, shared), (8, None), (9, ""), (10, "The. The. The. " * 40)]
    df = odd_documents(spark, rows)
    out = passages.substring_dedup(df)
    assert set(out.columns) == set(df.columns) and out.count() == len(rows)
    got = {r.doc_id: (r.text, r.removed) for r in out.collect()}
    assert got[1][0] == rows[0][1] and got[3][0] == rows[2][1] and got[4][0] == rows[3][1] and got[None][0] == shared and got[8][0] is None and got[9][0] == ""
    assert got[2][0] == clean[3] + "\n" and got[5][0] == "" and [x.words for x in got[5][1]] == [60]
    assert shared not in got[7][0] and clean[0] in got[7][0] and got[10][0] == rows[-1][1]
    assert passages.substring_dedup(odd_documents(spark, [])).count() == 0
    assert passages.bands_for(0.75, 0.99) == 4


def test_passages_pasted_inside_sentences(spark):
    """Verbatim repeats of just over 50 words go, wherever sentences begin and end; shorter ones stay."""
    rng = np.random.default_rng(11)

    def run(n, tag):
        return [f"{tag}{x}" for x in rng.integers(0, 3000, n)]

    rows, want = [], {}
    for k, (n, every) in enumerate((n, every) for n in (40, 49, 50, 51, 55, 60, 90) for every in (7, 23, 1000)):
        w = run(n, f"p{k}x")
        shared = " ".join(x + "." * (j % every == every - 1) for j, x in enumerate(w))
        a, b, c, d = (" ".join(run(15, f"{t}{k}x")) for t in "abcd")
        rows += [(2 * k, f"{a} {shared} {b}."), (2 * k + 1, f"{c} {shared} {d}.")]
        want[2 * k], want[2 * k + 1] = rows[-2][1], f"{c}  {d}." if n >= 50 else rows[-1][1]
    whole = [*run(12, "e"), "end."]
    left, right = run(30, "l"), run(30, "r")
    rows += [(100, " ".join(["Start", *left[:-1], "stop.", *whole * 2, *right]) + " one."), (101, " ".join([*left[9:-1], "stop.", *whole * 2, *right[:9]]) + " other.")]
    got = {r.doc_id: (r.text, r.removed) for r in passages.substring_dedup(odd_documents(spark, rows)).collect()}
    assert {k: got[k][0] for k in want} == want
    assert all(x.words == len(rows[k][1][x.place : x.place + x.size].split()) for k in want for x in got[k][1])
    assert got[100][0] == rows[-2][1] and got[101][0] == " other."


def test_near_paragraphs_are_found(spark):
    rng = np.random.default_rng(9)
    base = [f"n{x}" for x in rng.integers(0, 3000, 60)]
    other = list(base)
    other[0] = "different"
    docs = odd_documents(spark, [(1, " ".join(base) + "."), (2, " ".join(other) + ".")])
    got = {r.doc_id: r.text for r in passages.substring_dedup(docs).collect()}
    assert got[1] == " ".join(base) + "." and got[2] == ""


MIT_FILE = next(t for n, t in licenses.TEXTS if t.startswith("MIT License"))


def test_license_scan(spark):
    mit = "Released under the MIT License."
    header = "# Copyright 2020 The Authors\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\"); you may\n# not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\nimport x\n" + "code " * 400
    rows = [(1, "r/LICENSE", f"x\n{mit}"), (2, "r/a/f.txt", "no"), (3, "r/a/COPYING", "Licensed under CC BY-NC 4.0."), (4, "r/a/b/f.txt", None), (5, "s/f.txt", "y " * 50000), (6, "f.txt", mit.upper()), (7, None, mit), (8, "r/a/b/g.txt", ""),
            (None, "r/z", "the license of the under"), (9, "t/LICENSE", MIT_FILE.replace(". ", ".\n\n")), (10, "t/u/v.py", header), (11, "t/u/w.py", "# SPDX-License-Identifier: MPL-2.0\n"), (12, "t/u/z.py", " words" * 30000 + " MIT"),
            (13, "t/x", "Copyright (c) 2020 The Authors. Licensed under the Apache License, Version 2.0."), (14, "t/y", "This project is released under the MIT License, see the LICENSE file.")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, path string, text string, dir int, levels int")
    got = {r.doc_id: (r.license, r.via, r.levels) for r in licenses.license_scan(df).collect()}
    assert got == {1: ("MIT", "header", None), 2: ("CC-BY-NC-4.0", "directory", 0), 3: ("CC-BY-NC-4.0", "header", None), 4: ("CC-BY-NC-4.0", "directory", 1), 5: (None, "none", None),
                   6: ("MIT", "header", None), 7: ("MIT", "header", None), 8: ("CC-BY-NC-4.0", "directory", 1), None: ("MIT", "directory", 0), 9: ("MIT", "header", None), 10: ("Apache-2.0", "header", None),
                   11: ("MPL-2.0", "header", None), 12: ("MIT", "directory", 1), 13: ("Apache-2.0", "header", None), 14: ("MIT", "header", None)}
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_no_unit_is_lost(spark):
    """Units without a cue, or of too many tokens, stay below the threshold."""
    model = licenses.Model()
    rng = np.random.default_rng(10)
    vocabulary = [t for t in model.idf if t not in model.cues]
    lines = [" ".join(rng.choice(vocabulary, rng.integers(1, 12))) for _ in range(200)]
    lines += [" ".join(vocabulary)]
    best = licenses.best_score(F.col("x"), model)
    got = spark.createDataFrame([(x,) for x in lines], "x string").select(best["score"].alias("s")).collect()
    assert max(r.s for r in got) < model.threshold
    # a unit's score by the definition, and the bound on its tokens
    def plain(text):
        tokens = licenses._tokens(text)
        norm = np.sqrt(sum(model.idf.get(t, model.unseen) ** 2 for t in tokens)) or 1.0
        return max(sum(model.idf[t] * u[t] for t in tokens if t in u) / norm for u in model.units)
    texts = [t + " other" * (k % 3) + f" w{k}" * (k % 2) for k, (_, t) in enumerate(licenses.TEXTS)]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").select("k", best["score"].alias("s")).collect()
    assert all(r.s == pytest.approx(plain(texts[r.k]), abs=1e-6) for r in got)
    longest = max((t for _, t in licenses.TEXTS), key=lambda t: len(licenses._tokens(t)))
    assert plain(longest + "".join(f" v{k}" for k in range(model.most - len(licenses._tokens(longest)) + 1))) < model.threshold
