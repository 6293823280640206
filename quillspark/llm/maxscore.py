"""Exact top-k by inner product over sparse integer vectors, with MaxScore.

A block of candidates is a shard: for each dimension a posting list of the candidates
with a weight other than 0, and the least and largest weight, which bound what the list
can add to a query's score. A query's lists in order of their bounds are split so that
those after the split together add no more than a share of the k-th best score so far.
The lists before it (essential) are traversed; those after it are only probed, one by
one, for candidates whose sum so far, with all that the lists left can add, still reaches
the k-th score. A shard whose bounds together stay below that score is skipped. Every
weight is signed, so partial sums are exact and the bounds hold for negative products
too. Shards of a partition hand their k-th scores on; partitions merge by rank.

Queries are taken in blocks of bounded size, each against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quillspark.session import new_path

#: Queries of a block, sent to every task: 16,384 of 64 dimensions are 8 MB.
QUERY_BLOCK = 16_384
#: Rows of a shard.
SHARD = 16_384
#: Rows that give a query its first k-th score, queries that do so together, and the share of that score which probed lists may add.
SEED, TOGETHER, SHARE = 2048, 256, 0.25
#: A list that holds fewer of its shard's rows than one in so many is kept as rows and weights, others as a column.
SPARSE = 4
#: Largest component of ordinary vectors; larger ones are scored apart, in integers of any size.
ORDINARY = 1 << 20
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)


def quantised(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, rows, raw): floor(scale * x) in double precision of the usable vectors of (id, vector), short ones filled with 0.

    raw: whether scale * x is beyond doubles for a component; such a row holds the components themselves.
    """
    ids, vectors = batch.column(0), batch.column(1)
    size = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    row = np.repeat(np.arange(len(size)), size)
    usable = np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid())
    usable[row[~np.isfinite(x)]] = False
    width = int(size[usable].max()) if usable.any() else 0
    out = np.zeros((len(size), width))
    place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    keep = usable[row]
    out[row[keep], place[keep]] = x[keep]
    raw = np.abs(out).max(axis=1, initial=0) > np.finfo(np.float64).max / scale
    out[~raw] = np.floor(scale * out[~raw])
    return np.asarray(ids.fill_null(0), np.int64)[usable], out[usable], raw[usable]


class Shard:
    """The posting lists of a block of candidates with ordinary weights."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, kind: type = np.float64):
        self.ids, self.n, self.width = ids, len(ids), rows.shape[1]
        self.low, self.high = rows.min(axis=0), rows.max(axis=0)  # with 0 for candidates that a list leaves out
        held = np.count_nonzero(rows, axis=0)
        self.whole = held * SPARSE >= self.n
        self.at = np.cumsum(self.whole) - 1  # of a whole list: its column
        self.columns = np.ascontiguousarray(rows[:, self.whole].T.astype(kind))
        self.postings = {int(d): (r := np.flatnonzero(rows[:, d]), rows[r, d]) for d in np.flatnonzero(~self.whole & (held > 0))}

    def traverse(self, query: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The sum over these lists for all candidates."""
        whole = lists[self.whole[lists]]
        total = (query[whole].astype(self.columns.dtype) @ self.columns[self.at[whole]]).astype(np.float64) if len(whole) else np.zeros(self.n)
        for d in lists[~self.whole[lists]].tolist():
            if d in self.postings:
                rows, weights = self.postings[d]
                total[rows] += query[d] * weights
        return total

    def probe(self, d: int, rows: np.ndarray) -> np.ndarray:
        """The weights of list ``d`` for these candidates."""
        if self.whole[d]:
            return self.columns[self.at[d], rows].astype(np.float64)
        out = np.zeros(len(rows))
        if d in self.postings:
            held, weights = self.postings[d]
            at = np.minimum(np.searchsorted(held, rows), len(held) - 1)
            there = held[at] == rows
            out[there] = weights[at[there]]
        return out

    def seeds(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that k candidates reach, -inf where the first SEED rows are too few."""
        n, floors = min(SEED, self.n), np.full(len(queries), -np.inf)
        if n < k:
            return floors
        for a in range(0, len(queries), TOGETHER):
            part = queries[a : a + TOGETHER]
            score = part[:, self.whole].astype(self.columns.dtype) @ self.columns[:, :n]
            score = score.astype(np.float64)
            for d, (rows, weights) in self.postings.items():
                few = rows < n
                score[:, rows[few]] += part[:, d, None] * weights[few]
            score[query_ids[a : a + TOGETHER, None] == self.ids[:n]] = -np.inf
            floors[a : a + TOGETHER] = np.partition(score, n - k, axis=1)[:, n - k]
        return floors

    def search(self, query_id: int, query: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the candidates that score ``floor`` or more. query: of the shard's width."""
        bound = np.maximum(query * self.low, query * self.high)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)  # what the lists from there on can add
        if rest[0] < floor:
            return np.empty(0, np.int64), np.empty(0)
        split = int(np.argmax(rest <= max(floor, 0.0) * SHARE)) if floor > -np.inf else self.width
        score = self.traverse(query, order[:split])
        at = np.flatnonzero(score + rest[split] >= floor)
        at = at[self.ids[at] != query_id]
        score = score[at]
        for n in range(split, self.width):
            if not len(at):
                break
            d = int(order[n])
            score += query[d] * self.probe(d, at)
            competitive = score + rest[n + 1] >= floor
            if not competitive.all():
                at, score = at[competitive], score[competitive]
        return at, score


def _whole(rows: np.ndarray, raw: np.ndarray, scale: float) -> np.ndarray:
    """Rows as integers of any size; raw ones are scaled here."""
    exact = Fraction(scale)
    ints = [[floor(Fraction(c) * exact) for c in r] if wide else [int(c) for c in r] for r, wide in zip(rows.tolist(), raw.tolist())]
    return np.array(ints, object).reshape(rows.shape)


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of each query and row in integers of any size; those beyond 64 bits count as the largest, or least, of 64 bits."""
    width = min(queries.shape[1], rows.shape[1])
    score = queries[:, :width].dot(rows[:, :width].T) if width else np.zeros((len(queries), len(rows)), object)
    return np.array([[min(max(int(s), _LEAST), _MOST) for s in r] for r in score], np.int64).reshape(len(queries), len(rows))


class Best:
    """The k best candidates of each query so far: by score, then by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * queries

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(ids):
            return
        ids, scores = (np.concatenate(x) for x in zip(self.found[query], (ids, scores.astype(np.int64))))
        order = np.lexsort((ids, ~scores))[: self.k]  # ~s is -s - 1, which no s overflows
        self.found[query] = ids[order], scores[order]

    def floor(self, query: int) -> float:
        """No more than the k-th score, -inf where there are fewer."""
        scores = self.found[query][1]
        return float(scores[-1]) if len(scores) == self.k else -np.inf


def _fitted(rows: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` components, missing ones as 0."""
    return rows[:, :width] if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _search(queries, k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asked, asked_raw = queries.value
        best = Best(len(query_ids), k)
        large = asked_raw | (np.abs(asked).max(axis=1, initial=0) > ORDINARY)
        usual = np.flatnonzero(~large)

        def shard(ids: np.ndarray, rows: np.ndarray, raw: np.ndarray) -> None:
            huge = raw | (np.abs(rows).max(axis=1, initial=0) > ORDINARY)
            # what is not ordinary meets everything, one by one; then the rest
            for q, r in ((np.flatnonzero(large), np.arange(len(ids))), (usual, np.flatnonzero(huge))):
                for a in range(0, len(r) if len(q) else 0, 256):
                    part = r[a : a + 256]
                    whole = _whole(rows[part], raw[part], scale)
                    for b in range(0, len(q), 256):
                        some = q[b : b + 256]
                        for n, scores in zip(some.tolist(), _exact(_whole(asked[some], asked_raw[some], scale), whole)):
                            other = ids[part] != query_ids[n]
                            best.add(n, ids[part][other], scores[other])
            ids, rows = ids[~huge], rows[~huge]
            if not len(ids) or not len(usual):
                return
            peak = rows.shape[1] * np.abs(rows).max(initial=0) * np.abs(asked[usual]).max(initial=0)
            lists = Shard(ids, rows, np.float32 if peak < 1 << 24 else np.float64)  # either holds all sums exactly
            wanted = _fitted(asked[usual], lists.width)
            floors = np.array([best.floor(n) for n in usual.tolist()])
            new = np.flatnonzero(floors == -np.inf)
            floors[new] = lists.seeds(query_ids[usual[new]], wanted[new], k)
            for n, query, floor in zip(usual.tolist(), wanted, floors.tolist()):
                at, scores = lists.search(int(query_ids[n]), query, floor)
                best.add(n, ids[at], scores)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(quantised(batch, scale))
            if sum(len(i) for i, *_ in held) >= SHARD:
                shard(*_joined(held))
                held = []
        if held:
            shard(*_joined(held))
        for a in range(0, len(query_ids), 4096):
            part = best.found[a : a + 4096]
            sizes = [len(i) for i, _ in part]
            if sum(sizes):
                columns = np.repeat(query_ids[a : a + 4096], sizes), *(np.concatenate(x) for x in zip(*part))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _joined(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max(rows.shape[1] for _, rows, _ in held)
    ids, rows, raw = zip(*held)
    return np.concatenate(ids), np.concatenate([_fitted(r, width) for r in rows]), np.concatenate(raw)


HITS = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 64.0, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows, ties to the smaller vec_id.

    vectors, queries: vec_id, embedding (others are ignored). A vector that is null, or
    holds a null or non-finite component, or has a null vec_id, takes no part; of
    vectors of different length the missing components are 0, and an empty vector
    scores 0. A score beyond 64 bits is the largest, or least, of 64 bits. A row is no
    candidate for queries of its own vec_id. Rows that repeat a vec_id are candidates
    each; a query that repeats one is taken once, the first of its vectors in order.
    Fewer than k candidates are all returned; without queries the result is empty.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), "embedding").where("query_id IS NOT NULL AND embedding IS NOT NULL")
    asked = asked.groupBy("query_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-asked.count() // block))

    def hits(mine: DataFrame) -> DataFrame:
        table = mine.orderBy("query_id").toArrow().combine_chunks()  # some ``block`` rows
        batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)
        return rows.mapInArrow(_search(spark.sparkContext.broadcast(quantised(batch, scale)), k, scale), HITS)

    if blocks == 1:
        found = hits(asked)
    else:  # a job for each block, so that neither the plan nor what is sent at once grows with the queries
        path = new_path(spark, "hits")
        for n in range(blocks):
            hits(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)).write.parquet(f"{path}/block={n}")
        found = spark.read.schema(HITS).parquet(path)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
