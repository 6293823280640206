"""Substring deduplication: passages that repeat across and within documents, by MinHash banding.

The paragraphs that are compared are sentences: texts are cut after ``.``, ``!`` or
``?`` before a blank, and at newlines. Paragraphs of fewer than five words carry no
evidence of their own. A passage may begin and end inside a sentence, or hold no whole
one: therefore texts are also sampled for stretches of a third of ``min_words`` words, so
that of any ``min_words`` words in a row at least one stretch is sampled, whatever
stands around them ("anchors").

1. Every paragraph gets a hash of its words and MinHash values of its 5-word shingles;
   equal paragraphs are found by the hash, near ones by bands of MinHash values, tuned
   for recall at the threshold.
2. Colliding paragraphs are verified by exact Jaccard similarity of their shingles, and
   components of what links are the classes of repeated paragraphs.
3. A class keeps its first member (smallest doc_id, then place); so do equal anchors.
4. In each document the others are extended word by word on both sides, as far as the
   words equal those around the member that is kept. Runs of at least ``min_words``
   words go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from quillspark.llm import words
from quillspark.llm.jaccard import resolve, sketch
from quillspark.session import discard, materialize

#: Words of a run of repeated paragraphs from which on it is removed.
MIN_WORDS = 50
#: Least Jaccard similarity, as a fraction.
SIMILAR = (3, 4)
#: Signatures that a task holds before it writes them, and that one group gathers.
FLUSH, PER_GROUP, LEAST_GROUPS = 400_000, 1_000_000, 64
#: Words of a paragraph from which on another one can be alike and not equal: 3 shingles of 4.
LEAST_NEAR = words.SHINGLE + 2
#: Contexts up to which they are broadcast (some 230 bytes each); beyond, a context is dealt to so many tasks.
BROADCAST_ROWS, SALTS = 50_000, 8
_ANCHOR = np.uint64(1 << 40)  # tells an anchor's hash from that of a sentence of its words
_SPLIT = np.zeros(256, bool)
_SPLIT[[ord(c) for c in ".!?"]] = True


def bands_for(similarity: float, recall: float, rows: int = 1) -> int:
    """The fewest bands of ``rows`` MinHash values that catch a pair of that similarity with that probability.

    At 0.75 and 0.99 with one row: 4. Five-word shingles rarely meet by chance, so one
    row per band is selective enough and costs the fewest values.
    """
    n = 1
    while 1 - (1 - similarity**rows) ** n < recall:
        n += 1
    return n


BANDS = bands_for(0.75, 0.99)


class Paragraphs:
    """The paragraphs of a block of texts: text number, byte range, words, hash, and the words' hashes."""

    def __init__(self, raw: bytes, starts: np.ndarray):
        b = np.frombuffer(raw, np.uint8)
        self.begin, self.end, self.word = words.words(raw)
        n = len(self.word)
        self.text_of_word = np.searchsorted(starts, self.begin, "right") - 1
        self.sums = np.zeros(n + 1, np.uint64)
        if not n:
            self.first = self.last = self.text = self.size = np.empty(0, np.int64)
            self.hash = np.empty(0, np.uint64)
            return
        # a paragraph ends after a word that ends a sentence, or before a newline or another text
        newline = np.concatenate(([0], np.cumsum(b == 10)))
        ends = np.empty(n, bool)
        ends[-1] = True
        ends[:-1] = _SPLIT[b[self.end[:-1] - 1]] | (newline[self.begin[1:]] > newline[self.end[:-1]]) | (self.text_of_word[1:] != self.text_of_word[:-1])
        self.last = np.flatnonzero(ends) + 1  # words of paragraph k: first[k] to last[k]
        self.first = np.concatenate(([0], self.last[:-1]))
        self.size = self.last - self.first
        self.text = self.text_of_word[self.first]
        # a polynomial over the words, so that their order counts
        np.cumsum(self.word * words._power(words._BASE, "up", n), out=self.sums[1:])
        self.hash = self.hashes(self.first, self.size)

    def hashes(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The hash of each stretch of ``size`` words from word ``first`` on."""
        down = words._power(words._BASE_INV, "down", len(self.word))
        return words.mix((self.sums[first + size] - self.sums[first]) * down[first] + size.astype(np.uint64))

    def anchor_hashes(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return words.mix(self.hashes(first, size) ^ _ANCHOR)

    def anchors(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the sampled stretches of ``min_words`` // 2 words.

        A stretch is sampled if its hash is the least of some ``min_words`` words of one
        text; stretches of fewer than five different words carry no evidence.
        """
        size = min_words // 3
        n, wide = len(self.word) - size + 1, min_words - size + 1
        windows = n - wide + 1
        if windows < 1 or size < words.SHINGLE:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = self.anchor_hashes(np.arange(n), np.full(n, size))
        least = _sliding(h, wide, np.minimum)
        least[self.text_of_word[:windows] != self.text_of_word[min_words - 1 : min_words - 1 + windows]] = 0
        padded = np.zeros(windows + 2 * (wide - 1), np.uint64)
        padded[wide - 1 : wide - 1 + windows] = least
        at = np.flatnonzero(_sliding(padded, wide, np.maximum) == h)
        if len(at):
            held = np.sort(self.word[at[:, None] + np.arange(size)], axis=1)
            at = at[(held[:, 1:] != held[:, :-1]).sum(axis=1) + 1 >= words.SHINGLE]
        return at, h[at]

    def minhashes(self, which: np.ndarray, bands: int) -> np.ndarray:
        """[paragraph, band] for paragraphs of five words and more."""
        n = len(self.word)
        h = self.word[: n - words.SHINGLE + 1] * words._WEIGHTS[0]
        for k in range(1, words.SHINGLE):
            h += self.word[k : n - words.SHINGLE + 1 + k] * words._WEIGHTS[k]
        count = self.size[which] - words.SHINGLE + 1
        total = np.cumsum(count)
        at = np.arange(total[-1]) + np.repeat(self.first[which] - (total - count), count)
        h = h[at]
        cuts = total - count
        return np.stack([np.minimum.reduceat(words.mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) & (1 << 64) - 1)), cuts) for k in range(bands)], axis=1)


def _sliding(x: np.ndarray, wide: int, best: np.ufunc) -> np.ndarray:
    """The least (or largest) of each ``wide`` values in a row."""
    have = 1
    while 2 * have <= wide:
        x, have = best(x[:-have], x[have:]), 2 * have
    return best(x[: len(x) - (wide - have)], x[wide - have :])


def _first_two(para: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal paragraphs the first, which stands for all, and the second, which tells that there are more."""
    order = np.lexsort((place, doc, para))
    new = np.concatenate((np.ones(min(1, len(para)), bool), para[order][1:] != para[order][:-1]))
    return order[new], order[1:][~new[1:] & new[:-1]]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that few texts and marks are Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), np.int64)


def _by_group(group: np.ndarray, groups: int, *columns: np.ndarray) -> list[bytes]:
    """For each group the number of its rows and their columns, packed."""
    order = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[order], np.arange(groups + 1))
    columns = tuple(c[order] for c in columns)
    return [np.int64(b - a).tobytes() + b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cut[:-1], cut[1:])]


def _entries(groups: int, bands: int, min_words: int):
    """Blocks by group: (paragraph, doc_id, place) by the paragraph's hash, and (key, paragraph, doc_id) by the keys of its bands."""

    def pack(exact: list[tuple], near: list[tuple]) -> pa.RecordBatch:
        para, doc, place = (np.concatenate(x) for x in zip(*exact))
        out = _by_group((para >> np.uint64(32)) % np.uint64(groups), groups, para, doc, place.astype(np.int32))
        if near:
            key, para, doc = (np.concatenate(x) for x in zip(*near))
            five = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            more = _by_group((key >> np.uint64(40)) % np.uint64(groups), groups, five, para, doc)
            out = [a + b for a, b in zip(out, more)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(groups, dtype=np.int32)), pa.array(out, pa.binary())], names=["p", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, near, size = [], [], 0
        for batch in _slices(batches):
            ids = _ids(batch.column(0))
            for first, after, raw, starts in words.blocks(batch.column(1).to_pylist()):
                p = Paragraphs(raw, starts)
                which = np.flatnonzero(p.size >= words.SHINGLE)
                at, anchor = p.anchors(min_words)
                if not len(which) and not len(at):
                    continue
                doc, place, para = ids[first + p.text[which]], p.begin[p.first[which]] - starts[p.text[which]], p.hash[which]
                heads, seconds = _first_two(para, doc, place)
                text = p.text_of_word[at]
                a_doc, a_place = ids[first + text], p.begin[at] - starts[text]
                for rows in (heads, seconds):
                    exact.append((para[rows], doc[rows], place[rows]))
                for rows in _first_two(anchor, a_doc, a_place):
                    exact.append((anchor[rows], a_doc[rows], a_place[rows]))
                    size += len(rows)
                long = heads[p.size[which[heads]] >= LEAST_NEAR]
                if len(long):
                    m = p.minhashes(which[long], bands)
                    near += [(words.mix(m[:, k] + np.uint64(k + 1)), para[long], doc[long]) for k in range(bands)]
                size += len(heads) + len(seconds) + bands * len(long)
                if size >= FLUSH:
                    yield pack(exact, near)
                    exact, near, size = [], [], 0
        if exact:
            yield pack(exact, near)

    return run


def _collisions(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a group of blocks: repeated paragraphs with their first places (band false), and those that collide in a band with some document of theirs."""
    exact: list[tuple] = []
    near: list[tuple] = []
    for raw in pdf["block"]:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        exact.append((np.frombuffer(raw, np.uint64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n), np.frombuffer(raw, np.int32, n, 8 + 16 * n)))
        at = 8 + 20 * n
        if at < len(raw):
            m = int(np.frombuffer(raw, np.int64, 1, at)[0])
            wide = np.zeros((m, 8), np.uint8)
            wide[:, :5] = np.frombuffer(raw, np.uint8, 5 * m, at + 8).reshape(-1, 5)
            near.append((wide.view("<u8").ravel(), np.frombuffer(raw, np.uint64, m, at + 8 + 5 * m), np.frombuffer(raw, np.int64, m, at + 8 + 13 * m)))
    para, doc, place = (np.concatenate(x) for x in zip(*exact))
    order = np.lexsort((place, doc, para))
    para, doc, place = para[order], doc[order], place[order]
    head = np.flatnonzero(np.concatenate(([True], para[1:] != para[:-1])))
    many = head[np.diff(np.concatenate((head, [len(para)]))) > 1]
    out = [pd.DataFrame({"run": np.int64(0), "band": False, "para": para[many].view(np.int64), "doc_id": doc[many], "place": place[many].astype(np.int64)})]
    if near:
        key, para, doc = (np.concatenate(x) for x in zip(*near))
        order = np.lexsort((doc, para, key))
        key, para, doc = key[order], para[order], doc[order]
        head = np.concatenate(([True], key[1:] != key[:-1]))
        first = head | np.concatenate(([True], para[1:] != para[:-1]))
        run = np.cumsum(head) - 1
        rows = np.flatnonzero(first & (np.bincount(run, weights=first)[run] > 1))
        name = words.mix(key[rows] + np.uint64(int(pdf["p"].iloc[0]) << 40)).view(np.int64)
        out.append(pd.DataFrame({"run": name, "band": True, "para": para[rows].view(np.int64), "doc_id": doc[rows], "place": np.int64(0)}))
    return pd.concat(out, ignore_index=True)


def _paragraph_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(para, doc_id, place, h, sketch) of the wanted paragraphs of (doc_id, text, wanted array of hashes), each at its first place in the document."""
    for batch in _slices(batches):
        ids, wanted = _ids(batch.column(0)), batch.column(2).to_pylist()
        for first, after, raw, starts in words.blocks(batch.column(1).to_pylist()):
            p = Paragraphs(raw, starts)
            want = np.array(sorted({h for w in wanted[first:after] for h in w}), np.int64).view(np.uint64)
            rows = np.flatnonzero(np.isin(p.hash, want))
            order = np.lexsort((rows, ids[first + p.text[rows]], p.hash[rows]))
            rows = rows[order[np.concatenate(([True], p.hash[rows][order][1:] != p.hash[rows][order][:-1]))]] if len(rows) else rows
            sets = [np.unique(words.shingle_hashes(p.word[p.first[r] : p.last[r]], np.zeros(p.size[r], np.int64), 1)[1]) for r in rows]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            cols = [pa.array(p.hash[rows].view(np.int64)), pa.array(ids[first + p.text[rows]]), pa.array(p.begin[p.first[rows]] - starts[p.text[rows]])]
            cols += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([sketch(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["para", "doc_id", "place", "h", "sketch"])


def repeated_paragraphs(docs: DataFrame, n_words: int, bands: int = BANDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(para, doc_id, place): each repeated paragraph's or anchor's hash, and where the member that its class keeps stands."""
    groups = max(LEAST_GROUPS, int(n_words / 12 * (bands + 2) / PER_GROUP))
    blocks = docs.mapInArrow(_entries(groups, bands, min_words), "p int, block binary")
    collided = materialize(blocks.groupBy("p").applyInPandas(_collisions, "run long, band boolean, para long, doc_id long, place long"), "collisions")
    exact = collided.where("NOT band").select("para", "doc_id", "place")
    near = collided.where("band")
    holders = near.groupBy("para").agg(F.min("doc_id").alias("doc_id"))
    wanted = holders.groupBy("doc_id").agg(F.collect_set("para").alias("wanted"))
    listed = materialize(wanted, "wanted")
    found = docs.join(listed, "doc_id").mapInArrow(
        _paragraph_shingles, "para long, doc_id long, place long, h array<long>, sketch binary"
    )
    sets = materialize(found.groupBy("para").agg(*(F.min_by(c, F.struct("doc_id", "place")).alias(c) for c in ("doc_id", "place", "h", "sketch"))), "paragraphs")

    def verify(pairs: DataFrame, most: int | None) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("para").alias(side), F.col("h").alias(f"h{side}")), side)
        both = F.size(F.array_intersect("ha", "hb"))
        top, bottom = SIMILAR
        return materialize(pairs.where(bottom * both >= top * (F.size("ha") + F.size("hb") - both)).select("a", "b").distinct(), "links", most, 20_000)

    runs = materialize(near.select("run", F.col("para").alias("doc_id")).distinct(), "runs")
    components = resolve(runs, sets.select(F.col("para").alias("doc_id"), F.size("h").cast("long").alias("n_shingles"), "sketch"), verify)
    # where each repeated paragraph stands first; then where its class does
    linked = components.select(F.explode(F.array("node", "component")).alias("para")).distinct().join(sets, "para").select("para", "doc_id", "place")
    first = exact.unionByName(linked).groupBy("para").agg(F.min(F.struct("doc_id", "place")).alias("at"))
    named = first.join(components.withColumnRenamed("node", "para"), "para", "left").withColumn("class", F.coalesce("component", "para"))
    kept = named.groupBy("class").agg(F.min("at").alias("keep"))
    out = materialize(named.join(kept, "class").select("para", F.col("keep.doc_id").alias("doc_id"), F.col("keep.place").alias("place")), "repeated")
    discard(collided, listed, sets, runs)
    return out


MARK = "para long, doc_id long, place long, span long"
END = "doc_id long, at int, right boolean, k_doc long, k_place long, anchor boolean"
CONTEXT = "k_doc long, k_place long, right boolean, anchor boolean, context binary"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _occurrences(min_words: int):
    """MARK: the paragraphs and anchors that each document holds, at byte ``place``; ``span`` is the first word << 32, plus the number of words << 1, plus 1 for an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids = _ids(batch.column(0))
            for first, after, raw, starts in words.blocks(batch.column(1).to_pylist()):
                p = Paragraphs(raw, starts)
                which = np.flatnonzero(p.size >= words.SHINGLE)
                at, anchor = p.anchors(min_words)
                begin = np.concatenate((p.first[which], at))
                text = p.text_of_word[begin]
                n = np.concatenate((p.size[which] << 1, np.full(len(at), min_words // 3 << 1 | 1)))
                base = np.searchsorted(p.text_of_word, np.arange(after - first))  # first word of each text
                para = np.concatenate((p.hash[which], anchor)).view(np.int64)
                yield _batch(MARK, para, ids[first + text], p.begin[begin] - starts[text], (begin - base[text]) << 32 | n)

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and fields of an array<struct> column; a null list has no elements."""
    flat = column.flatten()
    counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
    return np.concatenate(([0], np.cumsum(counts))), {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}


def _ends(reach: int):
    """END: where the runs of a document's marks end, with the kept members that stand at most ``reach`` words from there, one of each kept document and shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out: list[tuple] = []
            offsets, marks = _lists(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:]):
                span, place, k_doc, k_place = (marks[x][a:b] for x in ("span", "place", "k_doc", "k_place"))
                start = span >> 32
                stop = start + ((span & 0xFFFFFFFF) >> 1)
                order = np.argsort(start, kind="stable")
                far = np.maximum.accumulate(stop[order])
                cuts = [0, *(np.flatnonzero(start[order][1:] > far[:-1]) + 1).tolist(), len(order)]
                for x, y in zip(cuts[:-1], cuts[1:]):
                    rows, low, high = order[x:y], start[order[x]], far[y - 1]
                    best: dict[tuple, int] = {}
                    for k in rows[start[rows] < low + reach][::-1].tolist():
                        best[int(k_doc[k]), int(k_place[k] - place[k]), False] = k  # the leftmost is the last to be put
                    near = rows[stop[rows] > high - reach]
                    for k in near[np.argsort(stop[near], kind="stable")].tolist():
                        best[int(k_doc[k]), int(k_place[k] - place[k]), True] = k
                    out += [(doc, int(stop[k] if right else start[k]), right, d, int(k_place[k]), bool(span[k] & 1)) for (d, _, right), k in best.items()]
            if out:
                yield _batch(END, *zip(*out))

    return run


def _contexts(reach: int, min_words: int):
    """CONTEXT of (doc_id, text, wanted array of (k_place, right, anchor)): the 32-bit hashes of up to ``reach`` words beside a kept member, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, wanted = _ids(batch.column(0)), batch.column(2).to_pylist()
            for first, after, raw, starts in words.blocks(batch.column(1).to_pylist()):
                p = Paragraphs(raw, starts)
                word = p.word.astype(np.uint32)
                edge = np.searchsorted(p.text_of_word, np.arange(after - first + 1))
                out: list[tuple] = []
                for t in range(after - first):
                    for place, right, anchor in (tuple(w.values()) for w in wanted[first + t]):
                        k = int(np.searchsorted(p.begin, starts[t] + place))
                        if k >= edge[t + 1] or p.begin[k] != starts[t] + place:
                            continue  # another row of this doc_id
                        if right:
                            k = k + min_words // 3 if anchor else int(p.last[np.searchsorted(p.last, k, "right")])
                            side = word[k : min(k + reach, edge[t + 1])]
                        else:
                            side = word[max(k - reach, edge[t]) : k][::-1]
                        out.append((int(ids[first + t]), place, right, anchor, side.tobytes()))
                if out:
                    yield _batch(CONTEXT, *zip(*out))

    return run


def _marks(docs: DataFrame, repeated: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, marks, sides): what of each document repeats a kept member, and the words beside that at the ends of runs."""
    reach = min_words - 1
    kept = repeated.withColumnsRenamed({"doc_id": "k_doc", "place": "k_place"})
    held = docs.mapInArrow(_occurrences(min_words), MARK).join(kept, "para").where("NOT (doc_id = k_doc AND place = k_place)")
    held = materialize(held.groupBy("doc_id").agg(F.collect_list(F.struct("para", "place", "span", "k_doc", "k_place")).alias("marks")), "marks")
    ends = materialize(held.mapInArrow(_ends(reach), END), "ends")
    wanted = ends.groupBy(F.col("k_doc").alias("doc_id")).agg(F.collect_set(F.struct("k_place", "right", "anchor")).alias("wanted"))
    wanted = materialize(wanted, "contexts-wanted")
    contexts = docs.join(wanted, "doc_id").mapInArrow(_contexts(reach, min_words), CONTEXT)
    key = ["k_doc", "k_place", "right", "anchor"]
    contexts = materialize(contexts.where("octet_length(context) > 0"), "contexts")
    if contexts.count() <= BROADCAST_ROWS:
        sides = ends.join(F.broadcast(contexts), key)
    else:  # a passage that many documents hold is met in several tasks
        salted = contexts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sides = ends.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*key, "salt"])
    sides = sides.groupBy("doc_id").agg(F.collect_list(F.struct("at", "right", "context")).alias("sides"))
    marks = F.transform("marks", lambda x: F.struct(x["para"].alias("para"), x["span"].alias("span")))
    out = materialize(held.select("doc_id", marks.alias("marks")).join(sides, "doc_id", "left"), "sides")
    discard(held, ends, wanted, contexts)
    return out


def _remove(text: str, raw: bytes, para: np.ndarray, span: np.ndarray, sides: list[dict], min_words: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without its runs of repeated words, and (byte place, bytes, words) of each run."""
    p = Paragraphs(raw + b" ", np.array([0, len(raw) + 1]))
    total = len(p.word)
    at, size, anchor = span >> 32, (span & 0xFFFFFFFF) >> 1, span & 1 == 1
    there = at + size <= total  # marks of another row of this doc_id do not count
    para, at, size, anchor = para[there].view(np.uint64), at[there], size[there], anchor[there]
    same = np.where(anchor, p.anchor_hashes(at, size), p.hashes(at, size)) == para
    edges = np.zeros(total + 1, np.int64)
    np.add.at(edges, at[same], 1)
    np.add.at(edges, (at + size)[same], -1)
    covered = np.cumsum(edges[:-1]) > 0
    marked, word = covered.copy(), p.word.astype(np.uint32)
    for side in sides:
        k, context = side["at"], np.frombuffer(side["context"], np.uint32)
        if side["right"]:
            if 0 < k <= total and marked[k - 1]:
                mine = word[k : k + len(context)]
                covered[k : k + _equal(mine, context)] = True
        elif k < total and marked[k]:
            mine = word[max(0, k - len(context)) : k][::-1]
            covered[k - _equal(mine, context) : k] = True
    # whole paragraphs of too few words to tell go with what stands on both sides of them
    able = covered | np.repeat(p.size < words.SHINGLE, p.size)
    change = np.flatnonzero(np.diff(np.concatenate(([False], able, [False])).astype(np.int8)))
    spans: list[tuple[int, int, int]] = []
    for a, b in zip(change[0::2].tolist(), change[1::2].tolist()):
        inside = np.flatnonzero(covered[a:b])
        if len(inside) and inside[-1] - inside[0] + 1 >= min_words:
            first, last = a + int(inside[0]), a + int(inside[-1])
            spans.append((int(p.begin[first]), int(p.end[last] - p.begin[first]), last - first + 1))
    if not spans:
        return text, []
    out, done = [], 0
    for begin, length, _ in spans:
        out.append(raw[done:begin])
        done = begin + length
    out.append(raw[done:])
    return b"".join(out).decode("utf-8", "surrogatepass"), spans


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many values at the beginning of both are equal."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else n


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, bands: int = BANDS) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and ``removed``: array of (place, size, words) in bytes of the old text.

    All rows and other columns stay, in any order; a column that is named ``removed``
    already is replaced. Null texts stay null. The first member of a class is that of
    the smallest doc_id, then place; rows that repeat a doc_id count as one document,
    so a passage at the same place of both stays in both. Rows of null doc_id are not
    compared and stay as they are.
    """
    source = docs.drop("removed")
    named = source.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = named.agg(F.sum(F.length("text"))).first()[0] or 0
    held = _marks(named, repeated_paragraphs(named, size // 6, bands, min_words), min_words)
    fields = source.schema.fields
    text_at, marks_at = source.columns.index("text"), len(fields)
    joined = source.join(held, source["doc_id"].cast("long") == held["doc_id"], "left").select(
        *(source[f.name] for f in fields), held["marks"].alias("marks__"), held["sides"].alias("sides__")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts, removed = [], []
            offsets, marks = _lists(batch.column(marks_at))
            para, span = marks["para"].astype(np.int64), marks["span"].astype(np.int64)
            for k, (text, sides) in enumerate(zip(batch.column(text_at).to_pylist(), batch.column(marks_at + 1).to_pylist())):
                spans: list = []
                a, b = offsets[k], offsets[k + 1]
                if text and b > a:
                    text, spans = _remove(text, text.encode("utf-8", "surrogatepass"), para[a:b], span[a:b], sides or [], min_words)
                texts.append(text)
                removed.append([{"place": a, "size": b, "words": c} for a, b, c in spans])
            cols = [pa.array(texts, batch.column(k).type) if k == text_at else batch.column(k) for k in range(marks_at)]
            kind = pa.list_(pa.struct([("place", pa.int64()), ("size", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, kind)], names=[*(f.name for f in fields), "removed"])

    schema = StructType([*fields, *StructType.fromDDL("removed array<struct<place:bigint,size:bigint,words:bigint>>").fields])
    return joined.mapInArrow(run, schema)


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, bands: int = BANDS) -> DataFrame:
    """``substring_dedup`` with ``n_chars``, where there is such a column, of the text that is left; null texts have none."""
    out = substring_dedup(docs, min_words, bands)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
