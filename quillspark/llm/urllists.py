"""URL filters: captures against dated lists, as of the time of each fetch.

A list's history is a series of events, "add" or "remove" an entry on a day. An entry's
events in order become validity intervals. Entries name a domain (with all below it) or
one page (host and path). Distinct hosts are matched with domains first, so that a host
with a third of all captures is matched once. The intervals of a host's (or page's)
entries part time into epochs, each with the entries that hold throughout it; an as-of
join then gives every capture the one epoch of its host, and of its page, that holds its
fetch time. So a capture is never multiplied, and nothing is gathered for a host but the
names of the lists that hold it: epochs come from running sums of what begins and ends
on a day, and a list's spans are dealt to the epochs that they cover by number. Hosts and
schemes are compared without regard to case, paths as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillspark.session import materialize

#: Measured bytes (as JSON) of the epochs of hosts or pages up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: Parts of a host's or page's captures where its epochs are too many to broadcast.
SALTS = 16
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)"
PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"
EVENTS = "list_name string, policy string, kind string, entry string, action string, listed_on date"


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL without its final dot; null where there is none."""
    host = F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit("."))
    return F.when(host != "", host)


def page_of(url: Column) -> Column:
    """Host and path of a URL without query, fragment and final slashes."""
    path = F.regexp_extract(url, f"(?i){PATH}", 1)
    return F.concat(host_of(url), F.rtrim(path, F.lit("/")))


def listed_page(entry: Column) -> Column:
    """A page entry as ``page_of`` names captures; an entry may leave the scheme out."""
    return page_of(F.when(F.lower(entry).rlike(r"^[a-z][a-z0-9+.-]*://"), entry).otherwise(F.concat(F.lit("http://"), entry)))


def listed_domain(entry: Column) -> Column:
    """A domain entry as ``host_of`` names hosts: lower-cased, without blanks, a leading "*." or dots at its ends."""
    return F.rtrim(F.regexp_replace(F.trim(F.lower(entry)), r"^\*?\.+", ""), F.lit("."))


def domains_of(host: Column) -> Column:
    """The host and every domain above it; nothing is above an address of numbers."""
    parts = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host.rlike(r"^\[|^\d+(\.\d+){3}$"), F.array(host)).otherwise(above)


def intervals(events: DataFrame) -> DataFrame:
    """list_name, policy, kind, entry, since, until (null: open) of dated events.

    An entry holds from an "add" up to its next event. Events that repeat count once; of
    an "add" and a "remove" on one day the "remove" counts last. Rows with a null list,
    kind, entry, action or day are no events. Domains are lower-cased.
    """
    events = events.withColumn("entry", F.when(F.col("kind") == "page", F.col("entry")).otherwise(F.lower("entry")))
    known = events.where("list_name IS NOT NULL AND kind IS NOT NULL AND entry IS NOT NULL AND action IS NOT NULL AND listed_on IS NOT NULL").distinct()
    w = Window.partitionBy("list_name", "policy", "kind", "entry").orderBy("listed_on", "action")
    spans = known.withColumn("until", F.lead("listed_on").over(w)).where("action = 'add' AND (until IS NULL OR until > listed_on)")
    return spans.select("list_name", "policy", "kind", "entry", F.col("listed_on").alias("since"), "until")


def epochs(found: DataFrame, key: str) -> DataFrame:
    """key, start, stop (null: open), n, lists, blocks, allows: the spans of time in which the same entries hold.

    found: key, list_name, policy, entry, since, until. Spans without entries are left out.
    """
    found = found.select(key, "list_name", "policy", "entry", "since", "until").distinct()
    begins, ends = found.select(key, "list_name", "policy", F.col("since").alias("day"), F.lit(1).alias("d")), found.where("until IS NOT NULL")
    steps = begins.unionByName(ends.select(key, "list_name", "policy", F.col("until").alias("day"), F.lit(-1).alias("d")))
    steps = materialize(steps.groupBy(key, "list_name", "policy", "day").agg(F.sum("d").alias("d")), f"steps-{key}")
    so_far = lambda *by: F.sum("d").over(Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    w = Window.partitionBy(key).orderBy("day")
    cuts = steps.groupBy(key, "day").agg(F.sum("d").alias("d"))
    cuts = cuts.select(key, F.col("day").alias("start"), F.lead("day").over(w).alias("stop"), so_far(key).alias("n"), F.row_number().over(w).alias("number"))
    cuts = materialize(cuts, f"cuts-{key}")
    # a list's spans, whichever of its entries hold
    of_list = [key, "list_name", "policy"]
    turns = steps.withColumn("on", so_far(*of_list)).withColumn("was", F.col("on") - F.col("d")).where("(on > 0) != (was > 0)")
    spans = turns.withColumn("until", F.lead("day").over(Window.partitionBy(*of_list).orderBy("day"))).where("on > 0")
    first = cuts.select(key, F.col("start").alias("day"), F.col("number").alias("first"))
    after = cuts.select(key, F.col("start").alias("until"), F.col("number").alias("after"))
    last = cuts.groupBy(key).agg(F.max("number").alias("last"))
    spans = spans.join(first, [key, "day"]).join(after, [key, "until"], "left").join(last, key)
    upto = F.coalesce(F.col("after") - 1, F.col("last"))
    dealt = spans.select(key, "list_name", "policy", F.explode(F.sequence("first", upto)).alias("number")).groupBy(key, "number").agg(
        F.array_sort(F.collect_set("list_name")).alias("lists"),
        F.bool_or(F.coalesce(F.col("policy") == "block", F.lit(False))).alias("blocks"), F.bool_or(F.coalesce(F.col("policy") == "allow", F.lit(False))).alias("allows"),
    )
    return cuts.join(dealt, [key, "number"]).select(key, "start", "stop", "n", "lists", "blocks", "allows")


def _as_of(captures: DataFrame, spans: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``: the epoch of the capture's key that holds its fetch time; at most one does."""
    spans = materialize(spans, f"epochs-{key}")
    size = spans.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    held = spans.select(F.col(key).alias("key__"), "start", "stop", F.struct("n", "lists", "blocks", "allows").alias(name))
    at = F.col("fetched_on")
    holds = (F.col("start") <= at) & (F.col("stop").isNull() | (at < F.col("stop")))
    if size <= BROADCAST_BYTES:
        return captures.join(F.broadcast(held), (captures[key] == F.col("key__")) & holds, "left").drop("key__", "start", "stop")
    # the captures of one host are met in several tasks, and those without one in as many
    held = held.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = captures.withColumn("part__", F.pmod(F.xxhash64("page_id", "url", at), F.lit(SALTS)).cast("int"))
    return rows.join(held, (rows[key] == F.col("key__")) & (rows["part__"] == F.col("salt__")) & holds, "left").drop("key__", "start", "stop", "salt__", "part__")


def match_lists(captures: DataFrame, events: DataFrame) -> DataFrame:
    """A row per capture (page_id, url, fetched_on): the entries active at its fetch and the verdict.

    n_entries: active entries that match; lists: the sorted names of their lists, joined
    by commas; blocked: some entry's policy is "block" and none's is "allow". A capture
    with a null or malformed URL, or a null time, matches nothing and is not blocked;
    rows that repeat are each returned; other columns of ``captures`` are ignored.
    """
    spans = intervals(events)
    rows = captures.select("page_id", "url", "fetched_on", host_of(F.col("url")).alias("host"), page_of(F.col("url")).alias("page"))
    hosts = rows.select("host").where("host IS NOT NULL").distinct().withColumn("entry", F.explode(domains_of(F.col("host"))))
    domains = spans.where("kind = 'domain'").withColumn("entry", listed_domain(F.col("entry"))).where("entry != ''")
    by_host = hosts.join(domains, "entry")
    pages = spans.where("kind = 'page'").withColumn("page", listed_page(F.col("entry")))
    rows = _as_of(_as_of(rows, epochs(by_host, "host"), "host", "of_host"), epochs(pages.where("page IS NOT NULL"), "page"), "page", "of_page")
    either = lambda field: F.coalesce(F.col(f"of_host.{field}"), F.lit(False)) | F.coalesce(F.col(f"of_page.{field}"), F.lit(False))
    none = F.array().cast("array<string>")
    return rows.select(
        "page_id", "host", "fetched_on", (F.coalesce("of_host.n", F.lit(0)) + F.coalesce("of_page.n", F.lit(0))).cast("long").alias("n_entries"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("of_host.lists", none), F.coalesce("of_page.lists", none))), ",").alias("lists"),
        (either("blocks") & ~either("allows")).alias("blocked"),
    )


def keep_allowed(captures: DataFrame, events: DataFrame) -> DataFrame:
    """page_id of the captures that no active entry blocks."""
    return match_lists(captures, events).where("NOT blocked").select("page_id")
