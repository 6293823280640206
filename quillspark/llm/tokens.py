"""Token ids of whole texts by a ``tokenizers`` file, each distinct word encoded once.

Valid for tokenizers that drop white space and whose tokens never span it; the
constructor checks the file for that. Then the ids of a text are those of its words,
one after the other. Words are told apart by 64-bit hashes that ignore the case of
A-Z, as the tokenizer does.
"""

from __future__ import annotations

import gc
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np

from quillspark.llm import words

#: Printable ASCII and Latin letters: nothing that normal form C changes.
_PLAIN = re.compile("[!-~\u00a1-\u017f]*").fullmatch
#: The visible character that byte-level BPE writes for each byte.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _SEEN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}
#: Distinct words kept by a worker; at about 150 bytes each, some 100 MB.
CACHE_WORDS = 400_000
#: Ids of all kept words together, and characters of their keys where those are texts; beyond either, words go too.
CACHE_IDS, CACHE_CHARS = 4_000_000, 16_000_000
#: Characters of a piece up to which its ids are remembered.
PIECE_CHARS = 64


class IdCache:
    """The ids of distinct words in one array; beyond ``limit`` words, or the bounds of ids and characters, those that were met once only are forgotten."""

    def __init__(self, limit: int = CACHE_WORDS):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.number: dict = {}
        self.starts = np.zeros(1, np.int64)  # ids of word k: flat[starts[k]:starts[k+1]]
        self.flat = np.empty(0, np.uint32)
        self.again = np.zeros(1, bool)  # whether word k was met again
        self.chars = 0

    def full(self, more: int) -> bool:
        n = len(self.number)
        return n > 0 and (n + more > self.limit or self.starts[n] > CACHE_IDS or self.chars > CACHE_CHARS)

    def shrink(self) -> None:
        """Keeps the words that were met again, the latest ones up to half of each bound."""
        keep = np.flatnonzero(self.again[: len(self.number)])[-(self.limit // 2) :]
        keys = list(self.number)
        within = np.ones(len(keep), bool)
        for size, most in ((self.starts[keep + 1] - self.starts[keep], CACHE_IDS), (np.array([self._chars(keys[k]) for k in keep.tolist()], np.int64), CACHE_CHARS)):
            within &= np.cumsum(size[::-1])[::-1] <= most // 2
        keep = keep[within]
        chosen = keep.tolist()
        flat, before = self.gather(keep)
        self.number = {keys[k]: i for i, k in enumerate(chosen)}
        self.starts, self.flat, self.again = before, flat, np.zeros(len(keep) + 1, bool)
        self.chars = sum(map(self._chars, self.number))

    @staticmethod
    def _chars(key) -> int:
        return len(key) if isinstance(key, (str, bytes)) else 0

    def numbers(self, keys: list, encode: Callable[[list[int]], list[list[int]]]) -> np.ndarray:
        """The numbers of ``keys``; ``encode`` gives the ids of keys[i] for each i of a list."""
        at = list(map(self.number.get, keys))
        if None in at:
            new = list({k: i for i, k in enumerate(keys) if at[i] is None}.values())
            if self.full(len(new)):
                self.shrink()
                at = list(map(self.number.get, keys))
                new = list({k: i for i, k in enumerate(keys) if at[i] is None}.values())
            known = len(self.number)
            paused = gc.isenabled()
            gc.disable()  # lists of ids hold no cycles, and are many
            try:
                self._learn([keys[i] for i in new], encode(new))
            finally:
                if paused:
                    gc.enable()
            at = np.fromiter(map(self.number.get, keys), np.int64, len(keys))
            self.again[at[at < known]] = True
            return at
        at = np.array(at, np.int64)
        self.again[at] = True
        return at

    def _learn(self, keys: list, encoded: list[list[int]]) -> None:
        base = len(self.number)
        self.number.update(zip(keys, range(base, base + len(keys))))
        self.chars += sum(map(self._chars, keys))
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        added = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
        ends = self.starts[base] + np.cumsum(sizes)
        need = int(ends[-1])
        if need > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(max(need, 2 * len(self.flat)) - len(self.flat), np.uint32)))
        self.flat[need - len(added) : need] = added
        if base + len(ends) + 1 > len(self.starts):
            more = max(len(ends) + 1, len(self.starts))
            self.starts = np.concatenate((self.starts, np.empty(more, np.int64)))
        if len(self.starts) > len(self.again):
            self.again = np.concatenate((self.again, np.zeros(len(self.starts) - len(self.again), bool)))
        self.starts[base + 1 : base + 1 + len(ends)] = ends

    def gather(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words numbered k, where those of each begin and the last end)."""
        start = self.starts[k]
        size = self.starts[k + 1] - start
        before = np.concatenate(([0], np.cumsum(size)))
        return self.flat[np.arange(before[-1], dtype=np.int64) + np.repeat(start - before[:-1], size)], before


class WordTokenizer:
    """Encodes distinct words once, and of those distinct pieces once.

    Words of printable ASCII and Latin letters are lower-cased and split here as the
    file says, and their pieces go to the tokenizer's own BPE model; any other word
    goes through the whole tokenizer.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        if split.get("type") != "Split" or split.get("behavior") != "Removed" or not split.get("invert"):
            raise ValueError("the tokenizer keeps white space; words can't be encoded one by one")
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in rest] == ["ByteLevel"]
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.cache = IdCache(cache_words)
        self.known: dict[str, tuple[int, ...]] = {}

    def _ids(self, word: str) -> list[int]:
        if not self.plain or not (word.isascii() and word.isprintable() or _PLAIN(word)):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        word = word.lower()
        pieces = (word,) if word.isalpha() else (word[:-1], word[-1]) if word[-1] in ".,;" and word[:-1].isalpha() else self.pieces(word)
        out: list[int] = []
        for piece in pieces:
            ids = self.known.get(piece)
            if ids is None:
                raw = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
                ids = tuple([t.id for t in self.model.tokenize(raw)])
                if len(piece) <= PIECE_CHARS:
                    self.known[piece] = ids
            out += ids
        return out

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null as empty."""
        for first, after, raw, starts in words.blocks(texts):
            begin, end, key = words.words(raw)
            keys, where, inverse = np.unique(key, return_index=True, return_inverse=True)
            if len(self.known) > self.cache.limit // 2:
                self.known.clear()
            k = self.cache.numbers(
                keys.tolist(), lambda new: [self._ids(raw[begin[i] : end[i]].decode("utf-8", "surrogatepass")) for i in where[new]]
            )
            ids, before = self.cache.gather(k[inverse])
            cut = before[np.searchsorted(begin, starts)]
            for i in range(after - first):
                yield ids[cut[i] : cut[i + 1]]


_kept: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """This process's tokenizer of that file; later tasks of a worker find the words already encoded."""
    if path not in _kept:
        _kept[path] = WordTokenizer(path)
    return _kept[path]
