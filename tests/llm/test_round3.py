"""Spelling variants, benchmark passages and compaction against brute force, and on odd rows."""

import datetime
import glob
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import compaction, leaks, queries, variants
from quillspark.session import read

ODD = "doc_id long, text string, word string, n long, form string, root string, key string, spans string, items int"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "f", "r", "k", "s", 2) for i, t in rows], ODD)


# ---- variants


def words_by_hand(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def variants_by_hand(rows):
    n = words_by_hand(rows)
    near = defaultdict(set)
    letters = {c for w in n for c in w}
    for w in n:
        for k in range(len(w) + 1):
            for other in {w[:k] + w[k + 1 :], *(w[:k] + c + w[k:] for c in letters), *(w[:k] + c + w[k + 1 :] for c in letters)}:
                if other != w and other in n:
                    near[w].add(other)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_of_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    got = found(queries.QUERIES["op11_spelling_variants"](spark, sf))
    assert got == variants_by_hand(rows) and sum(r[4] for r in got) > 0 and any(r[1] for r in got)


def test_variants_of_odd_texts(spark):
    rows = [(1, "Überfall überfall ÜBERFALL " * 3), (2, "letters " * 1000 + "leters lettters lettrs " * 90), (2, "letter " * 8 + "letterx letterx"), (None, "Letters letters×x letters÷"), (3, None), (4, ""), (5, "7 8 ퟿ 漢字letters漢字 ,,"), (6, "stressed desserts " * 4)]
    rows += [(7, "a" * 600 + " " + "b" * 7 + " "), (8, "a" * 599 + " " + "a" * 600), (9, "a" * 599 + " bbbbbbb"), (10, "lettersa lettersb lettersc " * 50 + "abcdefgh abcdefg bcdefgh " * 2)]
    df = odd(spark, rows)
    assert found(variants.variants(df)) == variants_by_hand(rows)
    assert variants.variants(df.limit(0)).count() == 0 and variants.variants(df.where("text IS NULL")).count() == 0


def test_chains_of_forms_and_ties(spark):
    """mmmmmmmm -> ... each ten times as frequent, and two forms of equal count."""
    rows = [(1, " ".join(["abcdefg"] * 20_000 + ["abcdefgh"] * 2_000 + ["abcdefghi"] * 200 + ["abcdefghij"] * 20)), (2, "xbcdefg " * 20_000), (3, "ybcdefg " * 3)]
    got = found(variants.variants(odd(spark, rows)))
    assert got == variants_by_hand(rows)
    by = {r[0]: r for r in got}
    assert by["abcdefghi"][2] == by["abcdefg"][2] and by["ybcdefg"][1] == "abcdefg"


def test_runs_are_split_in_pieces(monkeypatch):
    monkeypatch.setattr(variants, "PIECE", 5)
    assert [w for part in variants.runs("One, two-three fouré x") for w in part] == [b"one", b"two", b"three", b"four\xe9", b"x"]


# ---- leaks


def leaks_by_hand(docs, items, size=10):
    fold = lambda t: [m for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    low = lambda m: re.sub("[A-Z]", lambda c: c[0].lower(), m[0])
    windows = defaultdict(set)
    for name, text in items:
        w = [low(m) for m in fold(text)]
        for k in range(max(1, len(w) - size + 1)):
            if w:
                windows[tuple(w[k : k + size])].add(name)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        at = fold(text)
        w, hit, names = [low(m) for m in at], set(), set()
        for k in range(len(w)):
            for s in sizes:
                if k + s <= len(w) and tuple(w[k : k + s]) in windows:
                    hit |= set(range(k, k + s))
                    names |= windows[tuple(w[k : k + s])]
        runs = [k for k in sorted(hit) if k - 1 not in hit]
        ends = [k for k in sorted(hit) if k + 1 not in hit]
        out.append((i, len(w), len(hit), [(at[a].start(), at[b].end(), a, b - a + 1) for a, b in zip(runs, ends)], sorted(str(n) for n in names if n is not None)))
    return sorted(out, key=str)


def leaks_found(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], list(r["items"])) for r in df.collect()], key=str)


ITEMS = [(1, "What is the answer to the great question of life the universe and everything, asked Douglas?"), (2, "Forty-two."), (2, "So long and thanks"), (3, "一二 三 Forty"), (4, None), (5, "..."), (None, "thanks for all the fish"), (10, "what is THE answer to the great question of life the universe and more"), (7, "so so so")]
TEXTS = [(1, "He said: what is; the Answer to the great question of life, the universe and everything or not"), (1, "forty two forty TWO so long and thanks for all the fish 一二 三 forty two"), (None, "so so so so so"), (2, None), (3, ""), (4, "- - -"), (5, "is the answer to the great question of life"), (5, "is the answer to the great question of life"), (6, "é so long\x00and thanks for퟿ all the fish")]


def test_leaks_of_odd_texts(spark, monkeypatch):
    docs, items = odd(spark, TEXTS), spark.createDataFrame([(i, t, 9, "x") for i, t in ITEMS], "item_id long, text string, n_words int, spans string")
    want = leaks_by_hand(TEXTS, ITEMS)
    assert leaks_found(leaks.find_leaks(docs, items)) == want
    # several automata, some words each, give the same
    assert leaks_found(leaks.find_leaks(docs, items, automaton_words=9)) == want
    assert leaks_found(leaks.find_leaks(docs, items, window=3, automaton_words=9)) == leaks_by_hand(TEXTS, ITEMS, 3)
    assert leaks.find_leaks(docs.limit(0), items).count() == 0
    assert leaks_found(leaks.find_leaks(docs, items.limit(0))) == leaks_by_hand(TEXTS, [])


def test_leaks_across_pieces(monkeypatch):
    monkeypatch.setattr(leaks, "PIECE", 7)
    items = [(str(i), b" ".join(w for p in leaks.words_of(t or "") for w in p)) for i, t in ITEMS]
    for n, text in TEXTS:
        scanner = leaks.Scanner(items)
        words, hit, names = scanner.scan(text or "")
        (_, n_words, n_hit, spans, found), *_ = leaks_by_hand([(n, text)], [(str(i), t) for i, t in ITEMS])
        assert (words, sum(b - a for a, b in hit), leaks.spans(text or "", hit), sorted(names)) == (n_words, n_hit, spans, found)


def test_long_items_are_cut_with_overlap(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(90))
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = odd(spark, [(k, " ".join(f"w{j}" for j in range(k, k + 10))) for k in range(82)])
    monkeypatch.setattr(leaks, "PIECE_WORDS", 20)
    assert {r.n_hit for r in leaks.find_leaks(docs, items).collect()} == {10, 0} and leaks.find_leaks(docs, items, automaton_words=25).where("n_hit = 10").count() == 81


# ---- compaction


def first_fit(sizes, capacity):
    groups, out = [], []
    for n in sizes:
        at = next((k for k, g in enumerate(groups) if g + n <= capacity), None)
        if at is None:
            groups.append(0)
            at = len(groups) - 1
        groups[at] += n
        out.append(at)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_first_fit_by_blocks(seed):
    import random

    rng = random.Random(seed)
    sizes = sorted((rng.randint(0, 60) for _ in range(400)), reverse=seed % 2 == 0)
    bins = compaction.FirstFit(100, len(sizes) if seed else 3)
    assert [bins.put(n) for n in sizes] == first_fit(sizes, 100)


def compacted_by_hand(rows):
    """Rows (click_id, arrived_at, value) to the final files, without their paths."""
    share, days = (lambda x: 1 + len(rows) // x), Counter()
    day_of = lambda at: None if at is None else (at - datetime.datetime(1970, 1, 1)).days
    for _, at, _ in rows:
        days[day_of(at)] += 1
    files = defaultdict(list)
    for i, at, v in rows:
        h, d = zlib.crc32(("" if i is None else str(i)).encode()), day_of(at)
        files[d, h // 16 % (1 + days[d] // share(150)), min(h % 4, h // 4 % 4)].append((i, at, v))
    low = lambda x: (x is not None, x)
    for held in files.values():
        held.sort(key=lambda r: (low(r[1]), low(r[0])))
    out = []
    for d in days:
        mine = sorted((k for k in files if k[0] == d), key=lambda k: (-len(files[k]), k[1], k[2]))
        small = [k for k in mine if len(files[k]) < share(600)]
        groups = defaultdict(list)
        for k, g in zip(small, first_fit([len(files[k]) for k in small], share(500))):
            groups[g].append(k)
        for group in [*groups.values(), *([k] for k in mine if k not in small)]:
            held = [r for k in group for r in files[k]]
            ids = [r[0] for r in held if r[0] is not None]
            cents = sum(int((100 * v + 0.5) // 1) for _, _, v in held if v is not None and abs(v) < 1e300)
            text = ",".join("" if r[0] is None else str(r[0]) for r in held)
            out.append((*group[0], len(held), min(ids, default=None), max(ids, default=None), cents, ",".join(f"{k[1]}-{k[2]}" for k in group), hashlib.sha256(text.encode()).hexdigest(), len(group) > 1))
    return sorted(out, key=str)


FIELDS = ("day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "rewritten")


def compacted(df):
    return sorted((tuple(None if r[f] is None else r[f] for f in FIELDS) for r in df.collect()), key=str)


def test_compaction_of_the_table(spark, sf):
    table = read(spark, sf, "clicks")
    out = queries.QUERIES["op13_bin_packed_compaction"](spark, sf)
    rows = out.collect()
    assert compacted(out) == compacted_by_hand([(r.click_id, r.arrived_at, r.value) for r in table.collect()])
    assert len({r.rewritten for r in rows}) == 2 and {r["columns"] for r in rows} == {",".join(table.columns)}
    # the folder holds these files only, and all rows
    paths = {r.path.removeprefix("file:") for r in rows}
    paths = {f"/{p.lstrip('/')}" for p in paths}
    root = os.path.dirname(next(iter(paths))).rsplit("/", 3)[0]
    assert set(glob.glob(f"{root}/**/*.parquet", recursive=True)) == paths
    assert sorted(map(str, spark.read.parquet(root).select(table.columns).collect())) == sorted(map(str, table.collect()))


def test_compaction_of_odd_rows(spark):
    start, rows = datetime.datetime(2024, 1, 1), []
    for k in range(3000):
        day = 0 if k % 3 else k % 40
        rows.append((None if k % 211 == 0 else k // 2, None if k % 97 == 0 else start + datetime.timedelta(days=day, minutes=k % 700), None if k % 5 == 0 else float("nan") if k % 7 == 0 else float("inf") if k % 41 == 0 else k * 1.115 - 900))
    rows += rows[:50]
    schema = "click_id long, arrived_at timestamp_ntz, value double, Day string, lot string, piece int, place int, path string"
    df = spark.createDataFrame([(*r, "d", "l", 1, 2, "p") for r in rows], schema)
    out = compaction.compact_table(df)
    assert compacted(out) == compacted_by_hand(rows) and {r["columns"] for r in out.collect()} == {",".join(df.columns)}
    assert compaction.compact_table(df.limit(0)).collect() == []
    one = compaction.compact_table(df.limit(1).select("click_id", "arrived_at", F.lit(None).cast("double").alias("value"))).collect()
    assert len(one) == 1 and one[0].cents == 0 and one[0].rewritten is False


# ---- earlier operators


def test_finite_components_of_any_size_take_part(spark):
    from quillspark.llm import maxscore

    rows = [(0, [1e307, 1.0]), (1, [2e307, -1e307]), (2, [1e307, 2e307]), (3, [-1e307, 0.5]), (4, [0.25, 0.75]), (5, [1e-320, 1.7e308]), (4, [3.0, 1.0]), (20, [2.0, 1e307]), (20, [1.0, 1e307])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = lambda v: [int(x) * 64 if abs(x) > 1e18 else int(64 * x // 1) for x in v]
    got = sorted(map(tuple, maxscore.top_k(df, df.where("vec_id % 20 = 0"), 6).collect()))
    want = []
    for q, v in ((0, rows[0][1]), (20, rows[8][1])):
        scores = sorted((-min(max(sum(a * b for a, b in zip(whole(v), whole(w))), -(1 << 63)), (1 << 63) - 1), i) for i, w in rows if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:6])]
    assert got == sorted(want)


def warc_record(k, n, said=True, kind="response"):
    from quillspark.llm import warc

    body = bytes([65 + k % 26]) * n
    return warc.record(body, {"WARC-Type": kind, "X-Page-Id": str(k)} | ({"WARC-Payload-Digest": "sha1:" + warc.digest(body)} if said else {}))


def salvaged(stream, keep=True):
    from quillspark.llm import warc

    return [(h["x-page-id"] if h else n, s, len(b) if isinstance(b, bytes) else b.size if b else 0) for _, n, s, h, b in warc.salvage(stream, keep=keep)]


@pytest.mark.parametrize("keep", [True, False])
@pytest.mark.parametrize("zipped", [True, False])
def test_records_beyond_what_is_held(monkeypatch, zipped, keep):
    """Long records, whole and broken, plain and in one member, give and lose what short ones do."""
    import gzip
    import io

    from quillspark.llm import warc

    monkeypatch.setattr(warc, "HELD", 4096)
    monkeypatch.setattr(warc, "CHUNK", 1024)
    long, bad = warc_record(1, 20_000), warc_record(2, 30_000).replace(b"C" * 30_000, b"C" * 29_999 + b"D")
    nested = warc_record(3, 10, said=False)
    absurd = warc_record(6, 9_000).replace(b"Content-Length: 9000", b"Content-Length: 99999999999")
    inner = bad[:-20_000] + nested + bad[-20_000:]  # a broken block that holds a valid record
    parts = [warc_record(0, 10), long, inner, warc_record(4, 6_000, said=False), absurd, warc_record(5, 10)]
    raw = b"".join(parts)
    got = salvaged(io.BytesIO(gzip.compress(raw) if zipped else raw), keep)
    assert [x for x in got if x[1] == "ok"] == [("0", "ok", 10), ("1", "ok", 20_000), ("3", "ok", 10), ("4", "ok", 6_000), ("5", "ok", 10)]
    assert sum(x[1] == "gap" for x in got) == (1 if zipped else 3)
    if zipped:
        whole = gzip.compress(raw, mtime=0)
        cut = salvaged(io.BytesIO(whole[:-8] + bytes(8) + gzip.compress(parts[0])), keep)  # a check that fails: only digests vouch
        assert [x[0] for x in cut if x[1] == "ok"] == ["0", "1", "5", "0"]


def peak_mb(code):
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", f"import io, gzip, resource, tempfile\nfrom quillspark.llm import warc\n{code}\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert said.returncode == 0, said.stderr[-600:]
    return list(map(int, said.stdout.split()))


def test_memory_of_long_records_and_long_members():
    """A plain record of 300 MB, and one member of 10,000 records and 300 MB, are read in little more memory than the imports take."""
    begin = "f = tempfile.TemporaryFile()\nbase = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024\nprint(base)\n"
    plain = begin + "n = 300 << 20\nf.write(b'WARC/1.0\\r\\nX: 1\\r\\nContent-Length: %d\\r\\n\\r\\n' % n)\nfor _ in range(300): f.write(b'x' * (1 << 20))\nf.write(b'\\r\\n\\r\\n' + warc.record(b'y', {}))\nf.seek(0)\nprint(sum(s == 'ok' for _, _, s, _, _ in warc.salvage(f, keep=False)))"
    member = begin + "g = gzip.GzipFile(fileobj=f, mode='wb', compresslevel=1)\nfor k in range(10000): g.write(warc.record(b'z' * 30000, {'X': str(k)}))\ng.close()\nf.seek(0)\nprint(sum(s == 'ok' for _, _, s, _, _ in warc.salvage(f, keep=False)))"
    for code, n in ((plain, 2), (member, 10_000)):
        base, found, peak = peak_mb(code)
        assert found == n and peak - base < 100


def test_id_cache_is_bounded_by_ids_and_characters(monkeypatch):
    from quillspark.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_IDS", 400)
    monkeypatch.setattr(tokens, "CACHE_CHARS", 300)
    for kind in (str, int):
        cache = tokens.IdCache(1000)
        for k in range(200):
            keys = [kind(x) for x in (7, 10 + k, 7, 10 + k % 5, 10**20 + k)]
            encode = lambda new, keys=keys: [[int(keys[i]) % 1000] * (1 + int(keys[i]) % 9) for i in new]
            flat, before = cache.gather(cache.numbers(keys, encode))
            assert [flat[a:b].tolist() for a, b in zip(before, before[1:])] == [[int(x) % 1000] * (1 + int(x) % 9) for x in keys]
            assert cache.starts[len(cache.number)] <= 450 and cache.chars <= 350
        assert kind(7) in cache.number


def test_domain_entries_are_named_as_hosts(spark):
    from quillspark.llm import urllists

    day = datetime.date(2024, 1, 1)
    entries = [("a", "www.Dot.example."), ("b", "*.star.example"), ("c", "4"), ("d", "9.9.9.4"), ("e", "[::1]"), ("f", " . "), ("g", ".lead.example")]
    events = spark.createDataFrame([(n, "block", "domain", e, "add", day) for n, e in entries], urllists.EVENTS)
    urls = ["http://www.dot.example/x", "http://a.www.dot.example./", "http://x.star.example", "http://9.9.9.4/", "http://8.9.9.4", "http://[::1]:80/a", "http://[::2]/", "http://dot.example", "http://lead.example", "http://u@9.9.9.4:8080"]
    captures = spark.createDataFrame([(k, u, day) for k, u in enumerate(urls)], "page_id long, url string, fetched_on date")
    assert {r.page_id: r.lists for r in urllists.match_lists(captures, events).collect()} == {0: "a", 1: "a", 2: "b", 3: "d", 4: "", 5: "e", 6: "", 7: "", 8: "g", 9: "d"}
