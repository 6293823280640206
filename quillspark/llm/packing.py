"""Best-fit packing of token pieces into sequences, certified by dual feasible functions.

Each partition packs its pieces by best-fit decreasing and proves how many sequences it
needs at least: the largest of the bounds that a family of dual feasible functions
gives. Sequences that the bound does not prove necessary ("gaps") and each partition's
emptiest sequence are opened; their documents are exchanged between partitions, which
pack them again, until the total meets the bound over all pieces or a round gains
nothing. Only lengths and numbers move, never texts or ids.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.tokens import word_tokenizer
from quillspark.session import materialize

CAPACITY = 2048
#: Pieces that one task packs; a million pieces take about 200 MB there.
PIECES_PER_TASK = 200_000
MAX_ROUNDS = 6
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def dff_bound(counts: np.ndarray, capacity: int) -> int:
    """A proven minimum of sequences for ``counts[l]`` pieces of length l (1..capacity).

    The largest of: the total length; u(k)(x) = x if x(k+1) is a multiple of the
    capacity, else floor(x(k+1)/capacity) * capacity/k; and, for thresholds t up to
    half the capacity, the function that rounds lengths over capacity - t up to the
    capacity and drops those under t. Integers throughout, so it is never too large.
    """
    length = np.arange(len(counts), dtype=np.int64)
    n = counts.astype(np.int64)
    if not n.sum():
        return 0
    best = -(-int((n * length).sum()) // capacity)
    for k in range(1, 33):
        scaled = length * (k + 1)
        # in units of capacity * k, so that all is whole
        value = np.where(scaled % capacity == 0, length * k, scaled // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (capacity * k)))
    up = np.concatenate((np.cumsum(n[::-1])[::-1], [0]))  # pieces of at least that length
    mass = np.concatenate(([0], np.cumsum(n * length)))  # total length of pieces below it
    t = np.arange(1, capacity // 2 + 1)
    high = up[capacity - t + 1]
    middle = mass[capacity - t + 1] - mass[t]
    return max(best, int((high - (-middle // capacity)).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; bins from 0. Ties go to the bin that was filled to that level last."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set where room[r] has a bin
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = mask >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - left
        if left > length:
            room[left - length].append(b)
            mask |= 1 << (left - length)
    return bins, offsets


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (null text: as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    out.append((doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_SCHEMA)


def _pack_group(capacity: int, round_no: int):
    """Packs one group; ``open`` marks the sequences to be exchanged."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        lengths = df["length"].to_numpy(np.int64)
        # pieces in an order that does not depend on how they arrived
        order = np.lexsort((df["row"].to_numpy(), -lengths))
        lengths = lengths[order]
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n = int(bins.max()) + 1
        gap = n - dff_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, weights=lengths, minlength=n)
        # the emptiest sequence may meet another partition's; a gap of g may be closed by what is loosest
        loose = np.zeros(n, bool)
        candidates = np.argsort(fill, kind="stable")[: 1 + 8 * gap]
        loose[candidates[fill[candidates] < capacity]] = True
        return pd.DataFrame(
            {
                "row": df["row"].to_numpy()[order],
                "length": lengths,
                # number of the sequence: round, group, bin
                "sequence_id": (np.int64(round_no) << 56) + (np.int64(key[0]) << 28) + bins,
                "offset": offsets,
                "open": loose[bins],
            }
        )

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (doc_id, piece, length, ...).

    An empty table gives an empty table. Repeated rows are packed as often as they
    come; pieces of a null doc_id like any other. Sequences of one round number are
    disjoint from those of others. ``per_task`` bounds what one task packs; the number
    of groups grows with the pieces.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[length] = n
    rows, bound = int(histogram.sum()), dff_bound(histogram, capacity)
    out = "row long, length long, sequence_id long, offset long, open boolean"
    todo, placed, closed, before = pieces.select("row", "length"), [], 0, None
    for round_no in range(MAX_ROUNDS):
        if not rows:
            break
        groups = max(1, math.ceil(rows / per_task))
        # documents are dealt anew each round, so that gaps of different groups meet
        dealt = todo.withColumn("group", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(groups)))
        packed = materialize(dealt.groupBy("group").applyInPandas(_pack_group(capacity, round_no), out), f"packed{round_no}")
        n, loose, loose_rows = packed.agg(
            F.count_distinct("sequence_id"), F.count_distinct(F.when(F.col("open"), F.col("sequence_id"))), F.count_if("open")
        ).first()
        if before is not None and n >= before[1]:  # nothing gained: the pieces stay where they were
            placed.append(before[0])
            break
        # certified: no packing of all pieces takes fewer; or one group has packed what was open
        if closed + n <= bound or groups == 1 or round_no == MAX_ROUNDS - 1:
            placed.append(packed)
            break
        placed.append(packed.where(~F.col("open")))
        closed += n - loose
        before = packed.where("open"), loose
        todo, rows = before[0].select("row", "length"), loose_rows
    if not placed:
        places = spark.createDataFrame([], out)
    else:
        places = placed[0]
        for more in placed[1:]:
            places = places.unionByName(more)
    return pieces.join(places.select("row", "sequence_id", "offset"), "row").drop("row")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Tokenises whole texts, cuts only documents longer than ``capacity`` and packs the pieces.

    docs: doc_id, text (null: empty), other columns are ignored whatever their names.
    A document is its ids followed by ``end_id``, so an empty text is a piece of length
    1. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return pack_pieces(tokenize_pieces(docs, tokenizer_path, capacity, end_id), capacity, per_task)

