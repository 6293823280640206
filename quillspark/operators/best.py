"""The best rows of many targets at once, held in a task while its batches pass, so that only those are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Best:
    """The ``k`` rows of largest score of each of ``n`` targets, ties to the smaller id; some 4 * k * n rows are held."""

    def __init__(self, n: int, k: int):
        self.k, self.floors, self.rows = k, np.full(n, -np.inf), 0
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []

    def add(self, at: np.ndarray, ids: pa.Array, scores: np.ndarray) -> None:
        """scores: a row for each target of ``at`` and a column for each id; one of -inf takes no part."""
        q, r = self._passing(at, scores)
        n = scores.shape[1]
        if n > self.k and len(q) > 2 * self.k * len(at):  # k rows of this batch are as good as this
            self.floors[at] = np.maximum(self.floors[at], np.partition(scores, n - self.k, axis=1)[:, n - self.k])
            q, r = self._passing(at, scores)
        if len(q):
            self.held.append((at[q], ids.take(pa.array(r)), scores[q, r]))
            self.rows += len(q)
            if self.rows > 4 * self.k * len(self.floors) + 100_000:
                self._cut()

    def _passing(self, at: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(scores >= np.maximum(self.floors[at], np.finfo(np.float64).min)[:, None])

    def _cut(self) -> None:
        at, scores = (np.concatenate([p[i] for p in self.held]) for i in (0, 2))
        ids = pa.concat_arrays([p[1] for p in self.held])
        by_id = np.empty(len(ids), np.int64)
        by_id[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
        order = np.lexsort((by_id, -scores, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        order, at, place = order[place < self.k], at[place < self.k], place[place < self.k]
        scores = scores[order]
        last = place == self.k - 1
        self.floors[at[last]] = np.maximum(self.floors[at[last]], scores[last])
        self.held, self.rows = [(at, ids.take(pa.array(order)), scores)], len(at)

    def batches(self, size: int = 10_000) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """(targets, ids, scores) of all that is held."""
        if self.held:
            self._cut()
            at, ids, scores = self.held[0]
            for a in range(0, len(at), size):
                yield at[a : a + size], ids[a : a + size], scores[a : a + size]
