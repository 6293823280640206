"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The statistics are computed in numpy per text; the trees are grown on the driver from a
bounded sample of labelled rows and flattened into arrays, which every task traverses
for all its rows at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm import words

#: Labelled rows that a model is fitted on at most, the ones of smallest hash of doc_id.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_LEAF = 80, 4, 64, 0.15, 1.0, 8

FEATURES = (
    "log_chars", "log_words", "mean_word", "max_word", "distinct_words", "distinct_shingles", "top_word", "repeat_next",
    "letters", "upper", "digits", "blanks", "symbols", "exclaims", "pipes", "stops", "commas", "other_bytes", "upper_words",
    "symbol_words", "short_words", "log_lines", "mean_line", "short_lines", "distinct_lines", "ended_lines", "entropy",
)

_CLASS = np.zeros(256, np.int64)  # of a byte: 0 other ASCII punctuation, see below
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in "#$%&*@^~=+<>\\/{}[]_`"]] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[ord(".")] = 8
_CLASS[ord(",")] = 9
_CLASS[128:] = 10
_MARK = np.isin(np.arange(256), [ord(c) for c in "#$%&*@^~=+<>\\/{}[]_`|!"])


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES per text; null counts as empty, whose statistics are all 0."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, after, raw, starts in words.blocks(texts):
        out[first:after] = _block_statistics(raw, starts)
    return out


def _block_statistics(raw: bytes, starts: np.ndarray) -> np.ndarray:
    n = len(starts) - 1
    b = np.frombuffer(raw, np.uint8)
    of = np.repeat(np.arange(n), np.diff(starts))
    real = np.ones(len(b), bool)
    real[starts[1:] - 1] = False  # the blank put after each text
    chars = np.diff(starts) - 1
    each = np.bincount((of * 11 + _CLASS[b])[real], minlength=n * 11).reshape(n, 11)
    share = each / np.maximum(chars, 1)[:, None]
    # words
    begin, end, h = words.words(raw)
    word_of = of[begin] if len(begin) else np.empty(0, np.int64)
    size = end - begin
    n_words = np.bincount(word_of, minlength=n)
    per_word = np.maximum(n_words, 1)
    longest = np.zeros(n)
    np.maximum.at(longest, word_of, size)
    marks = np.concatenate(([0], np.cumsum(_MARK[b])))
    uppers = np.concatenate(([0], np.cumsum(_CLASS[b] == 2)))
    marked = (marks[end] - marks[begin]) > 0
    loud = (uppers[end] - uppers[begin] >= 2) & (2 * (uppers[end] - uppers[begin]) > size)
    order = np.lexsort((h, word_of))
    t, s = word_of[order], h[order]
    head = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])))) if len(t) else np.empty(0, np.int64)
    times = np.diff(np.concatenate((head, [len(t)])))
    distinct = np.bincount(t[head], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, t[head], times)
    share_of = times / per_word[t[head]]
    entropy = -np.bincount(t[head], weights=share_of * np.log(np.maximum(share_of, 1e-12)), minlength=n)
    again = (word_of[1:] == word_of[:-1]) & (h[1:] == h[:-1])
    repeats = np.bincount(word_of[1:][again], minlength=n) if len(h) > 1 else np.zeros(n)
    sh_of, sh = words.shingle_hashes(h, word_of, n)
    o = np.lexsort((sh, sh_of))
    a, c = sh_of[o], sh[o]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]))) if len(a) else np.empty(0, bool)
    n_shingles = np.bincount(sh_of, minlength=n)
    distinct_shingles = np.bincount(a[new], minlength=n)
    # lines: what stands between newlines, told apart by the sum of their words' hashes
    newline = (b == 10) & real
    line_of_byte = np.cumsum(newline) + of  # a new text starts a new line
    word_line = line_of_byte[begin] if len(begin) else np.empty(0, np.int64)
    total_lines = int(line_of_byte[-1]) + 1
    line_words = np.bincount(word_line, minlength=total_lines)
    line_sum = np.zeros(total_lines, np.uint64)
    np.add.at(line_sum, word_line, h)
    filled = np.flatnonzero(line_words)
    first_word = np.searchsorted(word_line, filled)
    text_of_line = word_of[first_word] if len(filled) else np.empty(0, np.int64)
    n_lines = np.bincount(text_of_line, minlength=n)
    per_line = np.maximum(n_lines, 1)
    short = np.bincount(text_of_line, weights=line_words[filled] < 5, minlength=n)
    last_word = np.searchsorted(word_line, filled, "right") - 1
    ended = np.isin(b[end[last_word] - 1], [ord(c) for c in ".!?"]) if len(filled) else np.empty(0, bool)
    o = np.lexsort((line_sum[filled], text_of_line))
    x, y = text_of_line[o], line_sum[filled][o]
    fresh = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.empty(0, bool)
    columns = {
        "log_chars": np.log1p(chars), "log_words": np.log1p(n_words), "mean_word": np.bincount(word_of, weights=size, minlength=n) / per_word,
        "max_word": longest, "distinct_words": distinct / per_word, "distinct_shingles": distinct_shingles / np.maximum(n_shingles, 1),
        "top_word": top / per_word, "repeat_next": repeats / per_word, "letters": share[:, 1] + share[:, 2], "upper": share[:, 2],
        "digits": share[:, 3], "blanks": share[:, 4], "symbols": share[:, 5], "exclaims": share[:, 6], "pipes": share[:, 7],
        "stops": share[:, 8], "commas": share[:, 9], "other_bytes": share[:, 10],
        "upper_words": np.bincount(word_of, weights=loud, minlength=n) / per_word,
        "symbol_words": np.bincount(word_of, weights=marked, minlength=n) / per_word,
        "short_words": np.bincount(word_of, weights=size <= 2, minlength=n) / per_word,
        "log_lines": np.log1p(n_lines), "mean_line": n_words / per_line, "short_lines": short / per_line,
        "distinct_lines": np.bincount(x[fresh], minlength=n) / per_line,
        "ended_lines": np.bincount(text_of_line, weights=ended, minlength=n) / per_line, "entropy": entropy,
    }
    return np.stack([np.asarray(columns[f], float) for f in FEATURES], axis=1)


@dataclass
class Trees:
    """Trees as arrays: node k of tree t tests feature[t, k] <= threshold[t, k]; its children are 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray  # [trees, inner nodes], -1 where all rows go left
    threshold: np.ndarray
    value: np.ndarray  # [trees, leaves]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of statistics."""
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[node]
                right = (f >= 0) & (x[rows, np.maximum(f, 0)] > threshold[node])
                node = 2 * node + 1 + right
            out += value[node - inner]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Grows trees on logistic loss by histograms of BINS quantile bins. One label only, or no rows: a constant."""
    inner, leaves = 2**depth - 1, 2**depth
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    feature = np.full((trees, inner), -1, np.int64)
    threshold = np.zeros((trees, inner))
    value = np.zeros((trees, leaves))
    if len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return Trees(base if len(y) else 0.0, feature, threshold, value)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    cell = binned + np.arange(d) * BINS
    out = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            k0, width = 2**level - 1, 2**level
            at = ((node - k0)[:, None] * (d * BINS) + cell).ravel()
            sums = [np.bincount(at, weights=np.repeat(w, d), minlength=width * d * BINS).reshape(width, d, BINS).cumsum(2) for w in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = -1
            for k in range(width):
                j, c = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
                if gain[k, j, c] > 1e-6 and c < len(cuts[j]):
                    feature[t, k0 + k], threshold[t, k0 + k] = j, cuts[j][c]
            f = feature[t, node]
            right = (f >= 0) & (x[np.arange(n), np.maximum(f, 0)] > threshold[t, node])
            node = 2 * node + 1 + right
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + L2)
        out += value[t][leaf]
    return Trees(base, feature, threshold, value)


def fold(doc_id: int | None, folds: int = 3) -> int:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text "null"."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: int | None = 1, limit: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``limit`` labelled documents of other folds than ``held_out``.

    Labels other than 0 and 1, and null ids, teach nothing; a doc_id whose labels differ
    neither. Of texts that repeat a doc_id the one of the least statistics counts, in
    whatever order they come.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    if held_out is not None:
        known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != held_out)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # at most ``limit`` rows of 12 bytes
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))],
                names=["doc_id", "y", "x"],
            )

    rows = found.mapInArrow(run, "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    rows = rows.toPandas().sort_values("doc_id")  # a row per doc_id of ``known``
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return x, rows["y"].to_numpy(float)


def score_documents(docs: DataFrame, model: Trees, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, in one pass without a shuffle.

    A null or empty text has the statistics of an empty one; rows of null or repeated
    doc_id are scored like any other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(statistics(batch.column(1).to_pylist()))
            held = [fold(i) == held_out for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Fits on the labelled rows that are not held out and scores every row of ``docs``.

    No label, language, source or id is an input of a score. Without usable labels all
    scores are 0.5.
    """
    return score_documents(docs, fit(*training_rows(docs, labels, label)))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of ``docs`` whose text scores 0.5 or more; all columns as they are."""
    model = fit(*training_rows(docs, labels, label))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(statistics(batch.column(at).to_pylist())) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
