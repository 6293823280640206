"""Benchmark passages inside documents: one Aho-Corasick automaton over the items' windows of words.

Texts are normalised to words: A-Z in lower case, everything but digits, letters and
characters beyond ASCII separates. An item's patterns are its windows of ten words, or
all its words where it has fewer. The automaton's alphabet is the benchmark's words, so a
document is scanned once, word by word, and any word that no item holds resets it. What
is found is mapped back to characters of the original text.

A benchmark of more than ``AUTOMATON_WORDS`` words makes several automata of that size,
one scan of the documents each: what one automaton takes is bounded, and all are used.

Null and empty texts have no words; an item without words has no pattern, one without an
id marks words but isn't named. Repeated rows give repeated results; an item_id that
stands in several rows names all their windows. Other columns are left alone.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 10
#: Words of the items of one automaton; with ten nodes for each at most it takes some 60 MB.
AUTOMATON_WORDS = 100_000
#: Words of a long item that stay together, besides those that overlap.
PIECE_WORDS = 2_000
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A word of an original text.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SPANS = "array<struct<start: long, end: long, first_word: long, n_words: long>>"


def words_of(text: str) -> Iterator[list[bytes]]:
    """The normalised words of a text in order, as UTF-8, in lists of bounded size."""
    raw = text.encode("utf-8", "surrogatepass").translate(_FOLDED)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Scanner:
    """The automaton of some items (id, words in UTF-8 with blanks between them)."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for name, words in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words.split())
            for k in range(max(1, len(ids) - window + 1)):
                if pattern := ids[k : k + window]:
                    of[pattern] |= {name} - {None}
        self.names = list(of.values())
        self.sizes = [len(p) for p in of]
        self.keep = max(self.sizes, default=1) - 1
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, pattern in enumerate(of):
            self.automaton.add_word(pattern, k)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(number of words, runs of hit words as (first, after), ids of items that occur)."""
        n, before, hit, names = 0, (), [], set()
        for words in words_of(text):
            if self.sizes:
                ids = (*before, *map(self.number.get, words, repeat(0)))
                base = n - len(before)
                for end, k in self.automaton.iter(ids):
                    first, after = base + end + 1 - self.sizes[k], base + end + 1
                    names |= self.names[k]
                    while hit and hit[-1][1] >= first:  # ends come in order
                        first = min(first, hit.pop()[0])
                    hit.append((first, after))
                before = ids[max(0, len(ids) - self.keep) :]
            n += len(words)
        return n, hit, names


def spans(text: str, hit: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of words as (start, end) characters of the text, with the first word and the number of words."""
    out, rest = [], iter(hit)
    first, after = next(rest, (-1, -1))
    for k, m in enumerate(_WORD.finditer(text) if hit else ()):
        if k == first:
            start = m.start()
        if k == after - 1:
            out.append((start, m.end(), first, after - first))
            first, after = next(rest, (-1, -1))
            if first < 0:
                break
    return out


def merged(held: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The union of spans that may overlap or repeat."""
    out: list[tuple[int, int, int, int]] = []
    for start, end, first, n in sorted(held):
        if out and first <= out[-1][2] + out[-1][3]:
            s, e, f, m = out[-1]
            out[-1] = (s, max(e, end), f, max(m, first + n - f))
        else:
            out.append((start, end, first, n))
    return out


def item_pieces(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(name, n, words): the items' normalised words, long items in pieces that overlap so that no window is lost."""

    def cut(batches):
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for part in words_of(value or "") for w in part]
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    part = words[at : at + PIECE_WORDS + window - 1]
                    rows += [(name, len(part), b" ".join(part))] if part else []
            names, sizes, parts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], names=["name", "n", "words"])

    return benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("t")).mapInArrow(cut, "name string, n long, words binary")


_scanners: dict[str, Scanner] = {}


def _scanned(docs: DataFrame, items: list[tuple[str | None, bytes]], window: int, token: str) -> DataFrame:
    """id, digest, n_words, spans, items of docs (id, text). token: tells the automata of a worker apart."""
    kind = dict(docs.dtypes)["id"]

    def run(batches):
        if token not in _scanners:
            _scanners.clear()
            _scanners[token] = Scanner(items, window)
        scanner = _scanners[token]
        for batch in batches:
            out = []
            for value in batch.column(2).to_pylist():
                n, hit, names = scanner.scan(value or "")
                out.append((n, [dict(zip(("start", "end", "first_word", "n_words"), s)) for s in spans(value or "", hit)], sorted(names)))
            n, found, names = zip(*out) if out else ((), (), ())
            span = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "first_word", "n_words")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(found, span), pa.array(names, pa.list_(pa.string()))], names=["id", "digest", "n_words", "spans", "items"]
            )

    return docs.select("id", "digest", "text").mapInArrow(run, f"id {kind}, digest string, n_words long, spans {SPANS}, items array<string>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items of every row of ``docs``.

    spans: runs of hit words as characters [start, end) of the text, with their first
    word and their number; items: the ids of the items that occur, sorted as strings.
    """
    pieces = item_pieces(benchmark, item_id, item_text, window).distinct()
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // automaton_words))
    shard = lambda k: pieces if shards == 1 else pieces.where(F.pmod(F.xxhash64("name", "words"), F.lit(shards)) == k)
    # what leaves is the items of one automaton at a time
    items = lambda k: [(r.name, bytes(r.words)) for r in shard(k).select(F.col("name"), "words").collect()]
    texts = docs.select(F.col(doc_id).alias("id"), F.lit(None).cast("string").alias("digest") if shards == 1 else F.sha2(text, 256).alias("digest"), F.col(text).alias("text"))
    token = uuid.uuid4().hex
    found = _scanned(texts, items(0), window, token)
    if shards > 1:
        # of equal texts one is enough, and few have a hit
        others = [_scanned(texts, items(k), window, f"{token}-{k}").where(F.size("spans") > 0).select("digest", F.lit(k).alias("k"), "spans", "items") for k in range(1, shards)]
        more = others[0]
        for other in others[1:]:
            more = more.unionByName(other)
        more = more.dropDuplicates(["digest", "k"]).groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("more"), F.flatten(F.collect_list("items")).alias("names"))
        both = found.join(more, "digest", "left")
        both = both.select("id", "digest", "n_words", F.concat("spans", F.coalesce("more", F.array().cast(SPANS))).alias("spans"), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("names", F.array().cast("array<string>"))))).alias("items"))
        found = both.mapInPandas(_merge, both.schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["n_words"])
    return found.select(F.col("id").alias(doc_id), "n_words", n_hit.alias("n_hit"), "spans", "items")


def _merge(frames):
    for pdf in frames:
        pdf["spans"] = [[dict(zip(("start", "end", "first_word", "n_words"), s)) for s in merged([(x["start"], x["end"], x["first_word"], x["n_words"]) for x in held])] for held in pdf["spans"]]
        yield pdf
