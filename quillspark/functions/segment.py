"""Words in runs of ideographs by a dictionary: the segmentation of largest probability.

Every way through a run is a path over the dictionary's words that begin at each place,
with single characters where no word does; the best path from each place on is found from
right to left, once. A word's probability is its share of the dictionary's counts, that
of an unknown character is a count of one. Of equal paths the one with the longer next
word is taken.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_RUN = re.compile("[一-鿿]+")
#: Words of a dictionary, which every worker holds: some 150 bytes each.
MOST_WORDS = 2_000_000
#: Distinct runs that a worker remembers.
REMEMBERED = 50_000


class Dictionary:
    """Words with their counts; a count that is missing or not positive counts as one."""

    def __init__(self, counts: Iterable[tuple[str, int | None]]):
        held = {w: max(int(n or 1), 1) for w, n in counts if w}
        self.total = math.log(max(sum(held.values()), 1))
        self.weights = {w: math.log(n) - self.total for w, n in held.items()}
        lengths = defaultdict(set)
        for w in held:
            lengths[w[0]].add(len(w))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}
        self.known: dict[str, list[str]] = {}

    def split(self, run: str) -> list[str]:
        if run not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[run] = self._split(run)
        return self.known[run]

    def _split(self, run: str) -> list[str]:
        n = len(run)
        best, step = [0.0] * (n + 1), [1] * (n + 1)
        for i in range(n - 1, -1, -1):
            ways = [(self.weights[w] + best[i + k], k) for k in self.lengths.get(run[i], ()) if i + k <= n and (w := run[i : i + k]) in self.weights]
            if run[i] not in self.weights:
                ways.append((best[i + 1] - self.total, 1))
            best[i], step[i] = max(ways)
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out


def dictionary_of(words: DataFrame, most: int = MOST_WORDS) -> Dictionary:
    """Of a table (word, n); it is held by every worker, so more than ``most`` words raise."""
    n = words.count()
    if n > most:
        raise ValueError(f"the dictionary has {n} words; workers hold at most {most}")
    return Dictionary((r.word, r.n) for r in words.select("word", "n").collect())


def parse_dictionary(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, n) of lines ``word count tag``, the count and the tag optional; a word that repeats has its last count in order."""
    part = F.split(F.trim(F.col(column)), r"\s+")
    rows = lines.select(F.get(part, 0).alias("word"), F.coalesce(F.get(part, 1).try_cast("long"), F.lit(1).cast("long")).alias("n")).where("word != ''")
    return rows.groupBy("word").agg(F.max("n").alias("n"))


def segmenter(dictionary: Dictionary) -> Callable[[Column], Column]:
    """A Column function from search tokens to search tokens: runs of ideographs as words, the others as they are.

    It works on Arrow batches and fits wherever ``text.bigrams`` does.
    """

    @F.pandas_udf("array<string>")
    def words(tokens: pd.Series) -> pd.Series:
        return pd.Series([None if row is None else [w for t in row for w in (dictionary.split(t) if _RUN.fullmatch(t) else (t,))] for row in tokens])

    return words
