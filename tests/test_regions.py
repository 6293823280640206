"""Rows of cells as tables, their titles, and regions below captions, a line at a time."""

import random
import re

from quillspark.operators import regions

LINES = "doc_id int, page int, ord int, x0 double, top double, x1 double, bottom double, text string"
NUMERIC = r"[-+0-9.,%/ ]+|(\d{4}[-/]\d{1,2}[-/]\d{1,2}\s*)+"


def rows_by_hand(lines):
    out = []
    for s in sorted((s for s in lines if not re.match("(资料来源|数据来源|来源)[:：]", s[7].strip())), key=lambda s: (s[4], s[3], s[2])):
        if out and abs(s[4] - sum(x[4] for x in out[-1]) / len(out[-1])) <= 0.75 * max(8.0, sum(x[6] - x[4] for x in out[-1]) / len(out[-1])):
            out[-1].append(s)
        else:
            out.append([s])
    return out


def cells_by_hand(row):
    groups = []
    for s in sorted((s for s in row if s[7].strip()), key=lambda s: (s[3], s[4])):
        for g in groups:
            a, b = min(x[3] for x in g), max(x[5] for x in g)
            if abs(s[3] - a) < 22 or max(0.0, min(b, s[5]) - max(a, s[3])) > 0.35 * min(s[5] - s[3], max(1.0, b - a)):
                g.append(s)
                break
        else:
            groups.append([s])
    return [" ".join(x[7] for x in sorted(g, key=lambda x: (x[4], x[3]))) for g in groups]


def tables_by_hand(lines, known):
    found, run = [], []
    numeric = lambda t: bool(re.fullmatch(NUMERIC, t.strip()))

    def close():
        nonlocal run
        held = [s for row in run for s in row]
        if len(run) >= 5:
            a, b, c, d = min(s[3] for s in held), min(s[4] for s in held), max(s[5] for s in held), max(s[6] for s in held)
            share = lambda p, q: max(0.0, min(p[2], q[2]) - max(p[0], q[0])) * max(0.0, min(p[3], q[3]) - max(p[1], q[1])) / max(1.0, (p[2] - p[0]) * (p[3] - p[1]))
            body = [cells_by_hand(r) for r in run]
            ok = c - a >= 0.34 * 600 and d - b >= 45 and not (b > 400 and re.search("电话|地址", " ".join(s[7] for s in held))) and sum(numeric(s[7]) for s in held) / len(held) <= 0.75
            ok = ok and not any(share((a, b, c, d), k) > 0.35 or share(k, (a, b, c, d)) > 0.35 for k in known)
            near = [s for s in lines if s[6] <= b and b - s[6] <= 28 and max(0.0, min(s[5], c) - max(s[3], a)) / max(1.0, min(s[5] - s[3], c - a)) > 0.15 and not numeric(s[7])]
            title = min(near, key=lambda s: (b - s[6], -len(s[7]), s[2]))[7] if near else ""
            if ok and not re.search("电话|地址", title):
                n = max(map(len, body))
                found.append((title, [r + [""] * (n - len(r)) for r in body]))
        run = []

    for row in rows_by_hand(lines):
        good = len(cells_by_hand(row)) >= 3 and any(not numeric(s[7]) and (s[3] + s[5]) / 2 < 0.42 * 600 and len(s[7].strip()) >= 2 for s in row)
        if run:
            before = run[-1]
            bottom, top = max(s[6] for s in before), min(s[4] for s in before)
            if not good or min(s[4] for s in row) - bottom > max(18.0, 2.5 * (bottom - top)):
                close()
        if good:
            run.append(row)
    close()
    return found


def test_dense_tables_by_hand(spark):
    rng = random.Random(6)
    lines, known, want = [], [], {}
    for page in range(1, 25):
        y, k, mine = 40.0, 0, []
        while y < 720:
            n = rng.choice([1, 2, 3, 3, 4, 4, 4]) if rng.random() < 0.35 else 4
            for at in range(n):
                x = 30 + 140 * at + rng.choice([0, 0, 5])
                text = rng.choice(["label", "甲项目", "12.5%", "2024-01-02", "电话 1", "  "]) if at == 0 else rng.choice(["3.5", "1,000", "n/a", "word"])
                text = text if rng.random() > 0.05 else "资料来源：x"
                mine.append((1, page, k, float(x), y + rng.choice([0, 1]), float(x + rng.choice([60, 100])), y + 12, text))
                k += 1
            y += rng.choice([20, 22, 22, 22, 22, 22, 75])
        lines += mine
        if page % 5 == 0:
            known.append((1, page, 20.0, 60.0, 580.0, 300.0))
        want[page] = tables_by_hand(mine, [k[2:] for k in known if k[1] == page])
    df = spark.createDataFrame(lines, LINES)
    pages = spark.createDataFrame([(1, p, 600.0, 800.0) for p in want], "doc_id int, page int, width double, height double")
    got = {p: [] for p in want}
    for r in regions.dense_tables(df, pages, spark.createDataFrame(known, "doc_id int, page int, x0 double, top double, x1 double, bottom double")).orderBy("page", "table_no").collect():
        got[r.page].append((r.title, r.rows))
        assert r.table_id == f"p{r.page}_dense_table_{r.table_no}" and r.text.startswith((r.title + "\n|") if r.title else "|")
    assert got == want and sum(map(len, want.values())) > 4
    assert regions.dense_tables(df.limit(0), pages).count() == 0 and regions.dense_tables(df, pages).count() >= sum(map(len, want.values()))


def test_regions_below_captions(spark):
    rng = random.Random(8)
    lines, want = [], {}
    for page in range(1, 12):
        tops = sorted(rng.uniform(20, 790) for _ in range(rng.randint(1, 130)))
        mine = [(1, page, k, 40.0, y, 300.0, y + rng.choice([10, 20]), rng.choice(["表1：甲", "图 2: x"] if rng.random() < 0.1 else ["text"])) for k, y in enumerate(tops)]
        lines += mine
        caption = lambda s: s[7] != "text"
        for i, c in enumerate(mine):
            if caption(c):
                ends = [j for j in range(i + 1, min(len(mine), i + 90)) if mine[j][4] - c[4] > 320 or caption(mine[j]) and mine[j][4] - c[4] > max(28.0, 2 * (c[6] - c[4])) or mine[j][4] > 0.92 * 800]
                want[page, i] = min(ends, default=min(len(mine), i + 90))
    pages = spark.createDataFrame([(1, p, 600.0, 800.0) for p in range(1, 12)], "doc_id int, page int, width double, height double")
    got = {(r.page, r.ord): r.after for r in regions.caption_regions(spark.createDataFrame(lines, LINES), pages).collect()}
    assert got == want and len(want) > 20


def test_what_is_a_table(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import layout

    grid = lambda r, c, text="cell": [[text] * c for _ in range(r)]
    cases = [(grid(3, 3), 300.0, 100.0, True), (grid(1, 3), 300.0, 100.0, False), (grid(3, 1), 300.0, 100.0, False), (grid(3, 3, ""), 300.0, 100.0, False), (grid(2, 2, "ab"), 300.0, 100.0, False), (grid(3, 3), 95.0, 100.0, False), (grid(3, 3), 300.0, 17.0, False),
             (grid(30, 3), 105.0, 700.0, False), (grid(5, 3), 550.0, 600.0, False), (grid(9, 3), 550.0, 600.0, True), (grid(9, 3, "x" * 181), 550.0, 600.0, False), (grid(5, 2, "x" * 421), 300.0, 300.0, False), (grid(12, 2, "x" * 421), 300.0, 300.0, True), ([], 300.0, 100.0, False)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, rows array<array<string>>, wide double, high double, want boolean")
    got = df.select("k", layout.is_table(F.col("rows"), F.col("wide"), F.col("high"), F.lit(595.0), F.lit(842.0)).alias("is"), "want").collect()
    assert {r.k for r in got if r["is"] != r.want} == set()


def test_parts_of_a_layout_block(spark):
    from quillspark.operators import layout

    rows = [(1, 1, "text", 7, 2, "b2", 10.0, 50.0, 90.0, 60.0, "second", [[1.0, 10.0, 90.0, 50.0, 60.0]], 1), (1, 1, "text", 7, 1, "b1", 20.0, 30.0, 80.0, 40.0, "first", None, 0), (1, 1, "text", 8, 3, "b3", 20.0, 30.0, 80.0, 40.0, "other", None, 0)]
    df = spark.createDataFrame(rows, "doc_id int, page int, type string, layoutno int, ord int, block_id string, x0 double, top double, x1 double, bottom double, text string, positions array<array<double>>, col_id int")
    got = {r.layoutno: r for r in layout.merge_layout(df).collect()}
    assert (got[7].text, got[7].x0, got[7].bottom, got[7].source_block_ids, got[7].col_ids, len(got[7].positions)) == ("first second", 10.0, 60.0, ["b1", "b2"], [0, 1], 1) and got[8].text == "other"
    assert layout.merge_layout(df.drop("positions", "col_id", "block_id")).columns[-1] == "text"


def test_rows_are_numbered_without_one_task(spark):
    from quillspark.session import numbered

    rows = spark.range(0, 997, 1, 7).selectExpr("id * 7919 % 997 AS t")
    assert sorted((r.t, r.n) for r in numbered(rows, "t", "n").collect()) == [(k, k + 1) for k in range(997)]
    assert numbered(rows.limit(0), "t", "n").count() == 0
