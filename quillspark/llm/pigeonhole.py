"""Signatures of shingle sets by universe partition, for Jaccard 0.75 and above.

Sets are put in size bands. In a band, every shingle hashes to one of m segments. Two
sets of Jaccard >= 3/4 differ in at most H = floor((|r| + |s|) / 7) shingles, so of any
choice of segments with allowances v_i (0, or 1 for "one shingle apart") that sum to
H + 1 as v_i + 1, one holds: segment i of r and s differs in at most v_i shingles.

* Bands of small sets take m = ceil((H + 1) / 2) segments, all with v = 1: each segment
  is indexed by its subset of shingles and by its one-deletion neighbourhood.
* Other bands take v = 0 and about 15 % more segments than H + 1. Each set indexes all
  its segments and probes the H + 1 that cost least: a segment costs what its rarest
  shingle does, by the classes of a table of frequent shingles, and an empty one most.
  Segments of frequent shingles alone, and empty ones, are hot; they are indexed, and
  meet a probe only where a set has too few others. The table only steers the choice:
  any choice finds the same pairs in the end.

A set also probes the next larger band if sets of that band can reach 3/4 with it.
"""

from __future__ import annotations

import numpy as np

from quillspark.llm.words import mix

SMALL = 32
RATIO = 1.6
SLACK = 1.15
INDEX, PROBE = np.uint8(1), np.uint8(2)
EMPTY = 63


def _bands() -> np.ndarray:
    """First sizes of the bands; any set of J >= 3/4 with one of band j, and larger, is in band j or j + 1."""
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, -(-lows[-1] * 4 // 3), int(lows[-1] * RATIO)))
    return np.array(lows, np.int64)


LOWS = _bands()
LAST = np.concatenate((LOWS[1:] - 1, [1 << 62]))
MOST_APART = 2 * LAST // 7
IS_SMALL = LAST <= SMALL
SEGMENTS = np.where(IS_SMALL, (MOST_APART + 2) // 2, np.ceil(SLACK * (MOST_APART + 1)).astype(np.int64) + 2)


def _first_of_each(group: np.ndarray, chosen: np.ndarray, limit: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks the first limit[g] chosen items of each group g; items are in order of groups. Also what is left of the limits."""
    total = np.cumsum(chosen)
    size = np.bincount(group, weights=chosen, minlength=n_groups).astype(np.int64)
    before = np.cumsum(size) - size
    return chosen & (total - before[group] <= limit[group]), np.maximum(limit - size, 0)


def _segment_signatures(which: np.ndarray, sizes: np.ndarray, band: np.ndarray, h: np.ndarray, h_doc: np.ndarray, h_class: np.ndarray, probe_only: bool):
    """(doc, signature, flags) of the docs ``which`` in their ``band``. h, h_doc, h_class: their shingles."""
    m = SEGMENTS[band]
    offset = np.cumsum(m) - m
    total = int(m.sum())
    doc_of = np.repeat(np.arange(len(which)), m)
    segment_of = np.arange(total) - offset[doc_of]
    salted = mix(h ^ mix(band.astype(np.uint64) + np.uint64(0x51ED27))[h_doc])
    at = offset[h_doc] + ((salted >> np.uint64(32)) * m[h_doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(total, np.uint64)
    value = mix(salted)
    np.add.at(sums, at, value)
    count = np.bincount(at, minlength=total)
    seed = mix((band[doc_of].astype(np.uint64) << np.uint64(40)) + segment_of.astype(np.uint64) + np.uint64(0xABCDEF))
    signature = mix(sums ^ seed)
    small = IS_SMALL[band]
    reach = np.minimum(4 * sizes // 3, LAST[band])
    need = np.where(small, 0, (sizes + reach) // 7 + 1)
    left = need
    probe = small[doc_of]
    cost = np.full(total, EMPTY, np.uint8)
    np.minimum.at(cost, at, h_class)
    cost[(cost == 0) & (count == 1)] = 1
    for level in np.flatnonzero(np.bincount(cost, minlength=1)):
        mark, left = _first_of_each(doc_of, (cost == level) & ~small[doc_of], left, len(which))
        probe = probe | mark
        if not left.any():
            break
    flags = np.where(probe, PROBE, np.uint8(0)) | (np.uint8(0) if probe_only else INDEX)
    keep = flags > 0
    docs, sigs, marks = [which[doc_of[keep]]], [signature[keep]], [flags[keep]]
    deleted = small[h_doc]
    if deleted.any():
        docs.append(which[h_doc[deleted]])
        sigs.append(mix((sums[at[deleted]] - value[deleted]) ^ seed[at[deleted]]))
        marks.append(np.full(int(deleted.sum()), PROBE | (np.uint8(0) if probe_only else INDEX), np.uint8))
    return np.concatenate(docs), np.concatenate(sigs), np.concatenate(marks)


def signatures(offsets: np.ndarray, hashes: np.ndarray, frequent: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, signature, flags) of sets hashes[offsets[i]:offsets[i+1]]; empty sets have none.

    frequent, classes: sorted hashes of frequent shingles and their classes, from 2 up with the frequency.
    """
    sizes = np.diff(offsets)
    h_class = np.zeros(len(hashes), np.uint8)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        known = frequent[at] == hashes
        h_class[known] = classes[at[known]]
    band = np.searchsorted(LOWS, sizes, "right") - 1
    h_doc = np.repeat(np.arange(len(sizes)), sizes)
    own = np.flatnonzero(sizes > 0)
    up = np.flatnonzero((sizes > 0) & (4 * sizes // 3 >= LOWS[np.maximum(band, 0) + 1]))
    parts = []
    for which, step in ((own, 0), (up, 1)):
        if not len(which):
            continue
        place = np.full(len(sizes), -1)
        place[which] = np.arange(len(which))
        there = place[h_doc] >= 0
        parts.append(_segment_signatures(which, sizes[which], band[which] + step, hashes[there], place[h_doc[there]], h_class[there], step == 1))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*parts))
