"""URL lists against brute force: overlapping entries of several lists, with and without broadcast."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.llm import urllists

START = date(2024, 1, 1)


def _brute(captures, events):
    """The active entries of each capture, by walking every entry's events."""
    spans = {}
    for name, policy, kind, entry, action, day in sorted(set(events), key=lambda e: (e[5], e[4])):
        spans.setdefault((name, policy, kind, entry), []).append((day, action))
    out = {}
    for page_id, url, day in captures:
        host = url.split("/")[2].lower()
        page = host + "/" + url.split("/", 3)[3].rstrip("/")
        parts = host.split(".")
        above = {".".join(parts[k:]) for k in range(len(parts))}
        active = []
        for (name, policy, kind, entry), turns in spans.items():
            now = [action for at, action in turns if at <= day]
            meets = entry in above if kind == "domain" else entry.split("://", 1)[1] == page
            if meets and now and now[-1] == "add":
                active.append((name, policy))
        policies = {p for _, p in active}
        out[page_id] = (len(active), ",".join(sorted({n for n, _ in active})), "block" in policies and "allow" not in policies)
    return out


@pytest.mark.parametrize("most", [urllists.BROADCAST_BYTES, 0])
def test_epochs_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(urllists, "BROADCAST_BYTES", most)
    rnd = random.Random(5)
    day = lambda: START + timedelta(days=rnd.randrange(30))
    domains, paths = ["a.test", "b.a.test", "c.b.a.test", "d.test", "test"], ["x", "X", "x/y"]
    captures = [(k, f"http://{rnd.choice(domains[:4])}/{rnd.choice(paths)}", day()) for k in range(200)]
    entries = [("domain", d) for d in domains] + [("page", f"https://{d}/{p}") for d in domains[:4] for p in paths]
    events = [(f"l{rnd.randrange(4)}", rnd.choice(["block", "block", "allow", None]), *rnd.choice(entries), rnd.choice(["add", "add", "remove"]), day()) for _ in range(400)]
    rows = urllists.match_lists(spark.createDataFrame(captures, "page_id int, url string, fetched_on date"), spark.createDataFrame(events, urllists.EVENTS)).collect()
    assert len(rows) == 200
    assert {r.page_id: (r.n_entries, r.lists, r.blocked) for r in rows} == _brute(captures, events)


def test_paths_keep_their_case(spark):
    captures = spark.createDataFrame([(0, "HTTP://A.Test/Secret/", START), (1, "http://a.test/secret", START), (2, None, START)], "page_id int, url string, fetched_on date")
    events = spark.createDataFrame([("l", "block", "page", "https://A.TEST/Secret#x", "add", START), ("m", "block", "page", "a.test/secret", "add", START)], urllists.EVENTS)
    assert {r.page_id: r.lists for r in urllists.match_lists(captures, events).collect()} == {0: "l", 1: "m", 2: ""}


def test_many_entries_of_one_host(spark):
    """5,000 entries of one host, each open for all days after its own: an epoch a day, the names of each list once."""
    days = spark.range(5000).select(
        F.concat(F.lit("l"), (F.col("id") % 3).cast("string")).alias("list_name"), F.lit("block").alias("policy"), F.lit("h").alias("host"), F.col("id").cast("string").alias("entry"),
        F.date_add(F.lit(START), (F.col("id") % 1000).cast("int")).alias("since"), F.lit(None).cast("date").alias("until"),
    )
    found = urllists.epochs(days, "host")
    top = found.agg(F.count("*").alias("epochs"), F.max("n").alias("n"), F.count_if(F.col("stop").isNull()).alias("open"), F.max(F.size("lists")).alias("lists")).first()
    assert (top.epochs, top.n, top.open, top.lists) == (1000, 5000, 1, 3)
