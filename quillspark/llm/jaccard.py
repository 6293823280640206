"""Exact self-join of texts by Jaccard similarity of their 5-word shingles, as components.

1. ``profile``: one pass over the texts gives each set's size, digest and parity sketch,
   and the shingles that are frequent somewhere. Equal sets collapse to one class.
2. ``candidate_runs``: a second pass writes each set's signatures (``pigeonhole``) in
   packed blocks; documents that share one, one of them probing, form a run.
3. Runs are resolved without listing their pairs: first each document against the
   smallest of its runs, then against one of the largest component in each run, then,
   inside tasks, all pairs of a run that are still in different components. Sketches
   discard pairs by a proven bound; what is left is verified on the sets themselves.

Documents of one component need no comparison, so a large group of near copies costs
its size, not its square, unless its members really are unlike each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm import pigeonhole, words
from quillspark.llm.components import connected_components
from quillspark.session import discard, materialize

#: Table of frequent shingles, which only steers the choice of segments: entries, and least share of the documents.
FREQUENT_ENTRIES, FREQUENT_SHARE, FREQUENT_LEAST = 1_000_000, 2000, 16
#: Signatures that a task holds before it writes them, and that one group gathers.
FLUSH, PER_GROUP, LEAST_GROUPS = 500_000, 750_000, 64
#: Hashes that a task counts at once, the counts and the digests it remembers: some 60 MB in all.
HELD, COUNTS, DIGESTS = 400_000, 600_000, 200_000
#: Documents of one side of a block of a run.
BLOCK = 1024
#: Rows that are compared in one group.
CELL_ROWS = 10_000
#: Ids up to which a list of documents is broadcast (8 bytes each, some 30 MB as a relation).
BROADCAST_IDS = 300_000


def digests(offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, whatever the order; 0 for the empty one."""
    n = len(offsets) - 1
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(h ^ np.uint64(salt)))))
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64) if n else np.empty(0, np.int64))
    return out[0], out[1]


def sketch(h: np.ndarray) -> bytes:
    """Parity of the counts of a set's shingles in 2**k >= max(64, 4 * size) cells, as bits."""
    width = 1 << max(6, int(4 * len(h) - 1).bit_length())
    odd = np.bincount((h >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """A lower bound of how many shingles two sets differ in, from their sketches."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class _Counts:
    """Counts of hashes seen in one task; the rarest half is forgotten beyond COUNTS of them."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, h: np.ndarray) -> None:
        self.held.append(h)
        self.size += len(h)
        if self.size > HELD:
            self.fold()

    def fold(self) -> None:
        if not self.size:
            return
        keys, counts = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        both = np.concatenate((self.keys, keys))
        order = np.argsort(both, kind="stable")
        both, n = both[order], np.concatenate((self.counts, counts))[order]
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        self.keys, self.counts = both[first], np.add.reduceat(n, first)
        if len(self.keys) > COUNTS:
            often = np.sort(np.argpartition(self.counts, -COUNTS // 2)[-COUNTS // 2 :])
            self.keys, self.counts = self.keys[often], self.counts[often]


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, offsets, hashes) for runs of texts of (doc_id, text) batches."""
    for batch in batches:
        ids = np.asarray(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        for first, after, offsets, h in words.shingle_sets(batch.column(1).to_pylist()):
            yield ids[first:after], offsets, h


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    counts = _Counts()
    names = ["doc_id", "n_shingles", "d1", "d2", "sketch", "frequent"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        first = 0
        for ids, offsets, h in _text_batches(iter([batch])):
            d1, d2 = digests(offsets, h)
            sizes = np.diff(offsets)
            known = d1.tolist()
            new = np.array([not (d in seen or seen.add(d)) for d in known], bool)
            counts.add(h[np.repeat(new, sizes)])
            if len(seen) > DIGESTS:
                seen.clear()
            cols = [batch.column(0).slice(first, len(ids)), sizes, d1, d2, [sketch(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], [None] * len(ids)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(cols, kinds)], names=names)
            first += len(ids)
    counts.fold()
    often = counts.counts >= 3
    for k in range(0, int(often.sum()), 500_000):
        part = np.stack((counts.keys[often][k : k + 500_000], counts.counts[often][k : k + 500_000].astype(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, -1, 0, 0, None, part.tobytes()), kinds)], names=names)


def _unpack_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            h, n = np.frombuffer(raw, np.uint64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def profile(docs: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(doc_id, n_shingles, d1, d2, sketch) of every row, and the frequent shingles with their classes."""
    table = materialize(docs.mapInArrow(_profile, "doc_id long, n_shingles long, d1 long, d2 long, sketch binary, frequent binary"), "sets")
    sets = table.where("n_shingles >= 0").drop("frequent")
    least = max(FREQUENT_LEAST, sets.count() // FREQUENT_SHARE)
    found = (
        table.where("n_shingles < 0").select("frequent").mapInArrow(_unpack_frequent, "h long, n long")
        .groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(FREQUENT_ENTRIES).toPandas()
    )
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    classes = np.minimum(2 + 2 * np.log2(found["n"].to_numpy(np.float64) / least), pigeonhole.EMPTY - 1).astype(np.uint8)
    return sets, h[order], classes[order]


def _pack(ids: list[np.ndarray], docs: list[np.ndarray], sigs: list[np.ndarray], flags: list[np.ndarray], groups: int) -> pa.RecordBatch:
    """A block per group: how many documents, their ids, how many signatures each, and five bytes of each signature with its flags."""
    doc_id = np.concatenate(ids)
    doc, sig, flag = np.concatenate(docs), np.concatenate(sigs), np.concatenate(flags)
    group = ((sig >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group * len(doc_id) + doc, kind="stable")
    doc, group = doc[order], group[order]
    key = (sig[order] << np.uint64(2)) | flag[order]
    raw = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    cut = np.searchsorted(group, np.arange(groups + 1))
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        first = np.flatnonzero(np.concatenate(([True], doc[a + 1 : b] != doc[a : b - 1]))) if b > a else np.empty(0, np.int64)
        each = np.diff(np.concatenate((first, [b - a]))).astype("<i4")
        out.append(np.int64(len(first)).tobytes() + doc_id[doc[a:b][first]].astype("<i8").tobytes() + each.tobytes() + raw[a:b].tobytes())
    full = [k for k, x in enumerate(out) if len(x) > 8]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([out[k] for k in full], pa.binary())], names=["p", "block"])


def _signature_blocks(groups: int, frequent, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = base = 0
        for ids, offsets, h in _text_batches(batches):
            # equal sets of a block: the smallest id stands for them
            d1, _ = digests(offsets, h)
            order = np.lexsort((ids, d1))
            keep = np.zeros(len(ids), bool)
            keep[order[np.concatenate(([True], d1[order][1:] != d1[order][:-1]))]] = True
            sizes = np.diff(offsets)
            h = h[np.repeat(keep, sizes)]
            offsets = np.concatenate(([0], np.cumsum(sizes[keep])))
            doc, sig, flag = pigeonhole.signatures(offsets, h, frequent.value, classes.value)
            for to, x in zip(held, (ids[keep], doc + base, sig, flag)):
                to.append(x)
            base += int(keep.sum())
            size += len(sig)
            if size >= FLUSH:
                yield _pack(*held, groups)
                held, size, base = ([], [], [], []), 0, 0
        if size:
            yield _pack(*held, groups)

    return run


def _runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """The runs of a group of blocks, each distinct one once: run, doc_id."""
    ids, keys = [], []
    for raw in pdf["block"]:
        k = int(np.frombuffer(raw, "<i8", 1)[0])
        each = np.frombuffer(raw, "<i4", k, 8 + 8 * k)
        ids.append(np.repeat(np.frombuffer(raw, "<i8", k, 8), each))
        wide = np.zeros((int(each.sum()), 8), np.uint8)
        wide[:, :5] = np.frombuffer(raw, np.uint8, offset=8 + 12 * k).reshape(-1, 5)
        keys.append(wide.view("<u8").ravel())
    doc, key = np.concatenate(ids), np.concatenate(keys)
    order = np.lexsort((doc, key >> np.uint64(2)))
    doc, probe, key = doc[order], (key[order] & np.uint64(2)) > 0, key[order] >> np.uint64(2)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    last = np.concatenate((first[1:], [len(key)]))
    meets = np.logical_or.reduceat(probe, first) & (doc[first] != doc[last - 1])
    # members of the runs that are left, each once
    first, last = first[meets], last[meets]
    size = last - first
    run = np.repeat(np.arange(len(first)), size)
    member = doc[np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)]
    new = np.concatenate(([True], (run[1:] != run[:-1]) | (member[1:] != member[:-1]))) if len(run) else np.empty(0, bool)
    run, member = run[new], member[new]
    # a run is named by its members, so that equal runs of all groups become one
    value = words.mix(member.astype(np.uint64) ^ np.uint64(0x5DEECE66D1234567))
    begin = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.empty(0, np.int64)
    name = words.mix(np.add.reduceat(value, begin)).view(np.int64) if len(run) else np.empty(0, np.int64)
    _, one = np.unique(name, return_index=True)
    chosen = np.zeros(len(name), bool)
    chosen[one] = True
    keep = chosen[run] if len(run) else np.empty(0, bool)
    return pd.DataFrame({"run": name[run[keep]] if len(run) else name, "doc_id": member[keep]})


def candidate_runs(docs: DataFrame, n_shingles: int, frequent: np.ndarray, classes: np.ndarray) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    groups = max(LEAST_GROUPS, int(0.65 * n_shingles / PER_GROUP))
    blocks = docs.mapInArrow(_signature_blocks(groups, sc.broadcast(frequent), sc.broadcast(classes)), "p int, block binary")
    return blocks.groupBy("p").applyInPandas(_runs, "run long, doc_id long").distinct()


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and sketches allow a link."""
    for batch in batches:
        rows = batch.to_pydict()
        keep = [
            4 * min(m, n) >= 3 * max(m, n) and 7 * least_apart(s, t) <= m + n
            for m, n, s, t in zip(rows["na"], rows["nb"], rows["sa"], rows["sb"])
        ]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, offsets, h in _text_batches(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))], names=["doc_id", "h"]
        )


def _semi(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def sketch_filter(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_plausible, "a long, b long")


def verify(docs: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """The pairs (a, b) of ids whose shingle sets have 100 * intersection >= 75 * union. most: a bound of the pairs, if known."""
    pairs = materialize(pairs.distinct(), "pairs", most)
    n = pairs.count()
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids", 2 * n)
    sets = materialize(_semi(docs, ids).mapInArrow(_sets, "doc_id long, h array<long>"), "shingles")
    joined = pairs
    for side in "ab":
        joined = joined.join(sets.select(F.col("doc_id").alias(side), F.col("h").alias(f"h{side}")), side)
    both = F.size(F.array_intersect("ha", "hb"))
    links = materialize(joined.where(100 * both >= 75 * (F.size("ha") + F.size("hb") - both)).select("a", "b"), "links", n, 5_000)
    discard(pairs, ids, sets)
    return links


def _label(runs: DataFrame, components: DataFrame) -> DataFrame:
    return runs.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, the longer folded to the shortest's width."""
    width = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), width), np.uint64)
    for i, s in enumerate(sketches):
        x = np.frombuffer(s, np.uint64)
        while len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def _cross(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different components within a block, or between two, that sizes and sketches allow; of many such cells."""
    pdf = pdf.sort_values(["run", "lo", "hi", "side", "doc_id"], kind="stable")
    doc, comp, n, side, run, lo, hi = (pdf[c].to_numpy(np.int64) for c in ("doc_id", "component", "n_shingles", "side", "run", "lo", "hi"))
    sketches = pdf["sketch"].tolist()
    new = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
    found = [np.empty((0, 2), np.int64)]
    for first, last in zip(new, np.concatenate((new[1:], [len(pdf)]))):
        middle = first + int(np.searchsorted(side[first:last], 1)) if side[last - 1] == 1 else first
        if comp[first:last].min() == comp[first:last].max():
            continue
        x = _folded(sketches[first:last])
        c, m, d = comp[first:last], n[first:last], doc[first:last]
        columns = slice(middle - first, None)
        step = max(1, (1 << 20) // max(1, x.size))
        for k in range(0, middle - first if middle > first else last - first, step):
            rows = slice(k, min(k + step, middle - first) if middle > first else k + step)
            able = (c[rows, None] != c[columns]) & (4 * np.minimum(m[rows, None], m[columns]) >= 3 * np.maximum(m[rows, None], m[columns]))
            i, j = np.nonzero(able)
            i, j = i + k, j + (middle - first)
            if middle == first:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 14):
                p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                apart = np.bitwise_count(x[p] ^ x[q]).sum(axis=1, dtype=np.int64)
                keep = 7 * apart <= m[p] + m[q]
                found.append(np.stack((np.minimum(d[p[keep]], d[q[keep]]), np.maximum(d[p[keep]], d[q[keep]])), axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _cross_pairs(labelled: DataFrame, sketches: DataFrame, n: int) -> DataFrame:
    """All plausible pairs of different components that share a run, dealt in cells of bounded size.

    Runs of more than one component that have the same smallest item are taken as one,
    so that a pair in many runs of one group is met once.
    """
    split = labelled.groupBy("run").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("doc_id").alias("least")).where("lo < hi")
    rows = materialize(labelled.join(split.select("run", "least"), "run").select(F.col("least").alias("run"), "doc_id", "component").distinct(), "split", n)
    parts = rows.groupBy("run").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    rows = rows.join(parts, "run").join(sketches, "doc_id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    rows = rows.withColumn("side", F.when((F.col("lo") != F.col("hi")) & (F.col("part") == F.col("hi")), 1).otherwise(0))
    cells = rows.select("run", "lo", "hi", "side", "doc_id", "component", "n_shingles", "sketch")
    # cells are many and mostly tiny: a group holds some thousand rows of them
    groups = max(LEAST_GROUPS, n // CELL_ROWS)
    return cells.groupBy(F.pmod(F.xxhash64("run", "lo", "hi"), F.lit(groups)).alias("group")).applyInPandas(_cross, "a long, b long")


def resolve(runs: DataFrame, sketches: DataFrame, verify: Callable[[DataFrame, int | None], DataFrame], links: DataFrame | None = None) -> DataFrame:
    """(node, component) of the items ``doc_id`` of ``runs``, by the links among items that share a run.

    sketches: doc_id, n_shingles, sketch of each item. verify: keeps of pairs (a, b)
    those that link, and is told a bound of their number or None. links: some that are
    known. Every pair that shares a run is verified, or ruled out by its sketches, or in
    one component by other links.
    """
    n = runs.count()
    # each item against the smallest that shares a run with it
    least = runs.groupBy("run").agg(F.min("doc_id").alias("a"))
    first = runs.join(least, "run").where("doc_id > a").groupBy(F.col("doc_id").alias("b")).agg(F.min("a").alias("a")).select("a", "b")
    found = verify(sketch_filter(first, sketches), n)
    links = found if links is None else links.unionByName(found)
    components = connected_components(links, "a", "b")
    # in each run, against some item of the component that has most of it
    labelled = materialize(_label(runs, components), "labelled", n)
    some = labelled.groupBy("run", "component").agg(F.count("*").alias("n"), F.min_by("doc_id", F.xxhash64("doc_id", "run")).alias("a"))
    some = some.groupBy("run").agg(F.max(F.struct("n", "a", F.col("component").alias("most"))).alias("x"), F.count("*").alias("parts"))
    some = some.where("parts > 1").select("run", "x.a", "x.most")
    second = labelled.join(some, "run").where("component != most").select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()
    links = links.unionByName(verify(sketch_filter(second, sketches), n))
    components = connected_components(links, "a", "b")
    discard(labelled)
    # what is left, whole
    labelled = materialize(_label(runs, components), "labelled", n)
    links = links.unionByName(verify(_cross_pairs(labelled, sketches, n), None))
    return connected_components(links, "a", "b")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text, any others).

    A text's set: its distinct 5-word shingles (``words``); with fewer words the whole
    sequence; without words, or null, empty, and such a row links with nothing. Two rows
    link at 100 * intersection >= 75 * union. component_id: the smallest doc_id that
    links reach. Rows that repeat a doc_id are all returned and are one node, linked by
    any of their texts; rows of null doc_id link with nothing and have a null
    component_id. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets, frequent, classes = profile(docs)
    named = docs.where("doc_id IS NOT NULL")
    keyed = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    rows = keyed.count()
    classes_of = materialize(keyed.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes", rows)
    copies = keyed.join(classes_of.where("copies > 1"), ["d1", "d2", "n_shingles"]).where("doc_id != rep").select("doc_id", "rep").distinct()
    copies = materialize(copies, "copies", rows)
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    runs = candidate_runs(named, total, frequent, classes)
    runs = runs.join(copies.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left").select("run", F.coalesce("rep", "doc_id").alias("doc_id")).distinct()
    runs = materialize(runs, "runs")
    sketches = materialize(keyed.join(runs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "sketch"), "sketches", rows, 20_000)
    links = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    components = resolve(runs, sketches, lambda pairs, most: verify(named, pairs, most), links)
    out = sets.select("doc_id", "n_shingles").join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less those that are near copies of a smaller doc_id's; all columns as they are."""
    drop = jaccard_components(docs).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
