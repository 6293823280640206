"""Words, 5-word shingles and distinct shingle sets of many texts at once, in numpy.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; all other
bytes of the UTF-8 text stay as they are. A word's 64-bit hash is a polynomial over
its bytes (odd base, modulo 2**64) put through a finalising mix; a shingle's is a
position-weighted sum of five word hashes, mixed again. Two different shingles of one
pair of documents collide with probability about 2**-64 each, which is the only
inexactness of what is built on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
#: Bytes of text hashed at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_WEIGHTS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        table = np.full(max(n, BLOCK_BYTES + 4096), base, np.uint64)
        table[0] = 1
        _powers[name] = np.multiply.accumulate(table)
        if len(table) > 8 * BLOCK_BYTES:  # a very long text: don't keep its tables
            return _powers.pop(name)
    return _powers[name][:n]


def blocks(texts: list[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, after, bytes, starts): runs of texts of about ``limit`` bytes, each text followed by a blank."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, i, b" ".join(held) + b" ", _starts(held)
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, len(texts), b" ".join(held) + b" ", _starts(held)


def _starts(held: list[bytes]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(x) + 1 for x in held]))).astype(np.int64)


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of a block; ``raw`` ends with a blank."""
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LOWER[b] * _power(_BASE, "up", len(b)), out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * _power(_BASE_INV, "down", len(b))[start])


def shingle_hashes(word: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle, repeats included. word, text: each word's hash and its text's number, ascending.

    A text of fewer than five words has one shingle, the whole sequence; one without words has none.
    """
    n = len(word)
    counts = np.bincount(text, minlength=n_texts)
    parts_t, parts_h = [], []
    if n >= SHINGLE:
        last = n - SHINGLE + 1
        whole = text[:last] == text[SHINGLE - 1 :]
        h = word[:last] * _WEIGHTS[0]
        for k in range(1, SHINGLE):
            h += word[k : last + k] * _WEIGHTS[k]
        parts_t.append(text[:last][whole])
        parts_h.append(mix(h)[whole])
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)))[short]
        h = counts[short].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for k in range(SHINGLE - 1):
            there = counts[short] > k
            h[there] += word[first[there] + k] * _WEIGHTS[k]
        parts_t.append(short)
        parts_h.append(mix(h))
    if not parts_t:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(parts_t), np.concatenate(parts_h)


def shingle_sets(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, after, offsets, hashes) for runs of texts: hashes[offsets[i]:offsets[i+1]] is the sorted set of text first+i."""
    for first, after, raw, starts in blocks(texts):
        begin, _, word = words(raw)
        text = np.searchsorted(starts, begin, "right") - 1
        t, h = shingle_hashes(word, text, after - first)
        order = np.lexsort((h, t))
        t, h = t[order], h[order]
        if len(h):
            new = np.empty(len(h), bool)
            new[0] = True
            np.logical_or(t[1:] != t[:-1], h[1:] != h[:-1], out=new[1:])
            t, h = t[new], h[new]
        yield first, after, np.searchsorted(t, np.arange(after - first + 1)), h
