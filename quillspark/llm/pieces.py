"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a text's characters: at each position the automaton's state and its
output links give every piece that ends there, longest first, and each relaxes the best
path to that position.

* Unigram models: the path of the highest sum of scores (Viterbi); ties go to the
  longest last piece.
* BPE models: merging by score does not maximise a sum, so a piece may follow the path's
  last piece only if merging the two of them alone leaves both as they are; exactly one
  piece passes at each position, and the path is what the merges give.

Pieces hold the blank mark only at their start, so a text falls apart before every run of
marks, and each distinct word is encoded once.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.tokens import IdCache

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What an unknown character costs below the worst piece, in unigram models.
UNKNOWN_PENALTY = 10.0
#: Distinct words that a worker keeps encoded, some 150 MB.
KEPT_WORDS = 500_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class PieceModel:
    """A model file's pieces, flags and automaton; encodes and decodes texts."""

    def __init__(self, raw: bytes):
        import ahocorasick

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer = normalizer = b""
        for number, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.types.append(kind)
            elif number == 2:
                trainer = value
            elif number == 3:
                normalizer = value
        spec = dict(_fields(trainer))
        rules = dict(_fields(normalizer))
        self.kind = spec.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be read")
        if rules.get(2) or rules.get(4, 1):
            raise ValueError("models that rewrite characters or drop blanks can't be read")
        self.prefix = bool(rules.get(3, 1))
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.unknown = self.types.index(UNKNOWN)
        self.id = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER)}
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("a piece holds a blank after another character; words can't be encoded one by one")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        lone = [c for c in "\n\t\r" if not any(c in p for p in self.id)]
        self.words = re.compile(f"{BLANK}*[^{BLANK}{''.join(lone)}]+|{BLANK}+" + (f"|[{''.join(lone)}]" if lone else "")).findall
        self.worst = min((self.scores[i] for i in self.id.values()), default=0.0) - UNKNOWN_PENALTY
        self.follows: dict[tuple[int, int], bool] = {}
        self.stands = [self.types[i] in (NORMAL, USER) and self._merge(p) == [p] for i, p in enumerate(self.pieces)] if self.kind == BPE else []
        self.text = [
            b"" if self.types[i] == CONTROL else bytes([int(p[3:5], 16)]) if self.types[i] == BYTE else p.replace(BLANK, " ").encode() if i != self.unknown else " ⁇ ".encode()
            for i, p in enumerate(self.pieces)
        ]
        self.cache = IdCache(KEPT_WORDS)

    def _merge(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored adjacent pair merges, the leftmost of equals, until none can."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            p, q = self.pieces[a], self.pieces[b]
            known = self.follows[key] = self._merge(p + q) == [p, q]
        return known

    def _unknown_char(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        return self._encode_bpe(word) if self.kind == BPE else self._encode_unigram(word)

    def _encode_bpe(self, word: str) -> list[int]:
        n = len(word)
        last = [-2] * (n + 1)  # the piece that ends the path there; -1: the start or an unknown character
        last[0] = -1
        back = [0] * (n + 1)
        done = 0  # positions up to here have their path
        stands, may_follow = self.stands, self._may_follow
        for end, (i, size) in self.automaton.iter(word):
            end += 1
            while done < end - 1:  # no piece ended there: an unknown character
                done += 1
                if last[done] == -2:
                    last[done], back[done] = -1, done - 1
            if last[end] != -2:
                continue
            before = last[end - size]
            if stands[i] if before == -1 else may_follow(before, i):
                last[end], back[end] = i, end - size
        while done < n:
            done += 1
            if last[done] == -2:
                last[done], back[done] = -1, done - 1
        return self._path(word, last, back)

    def _encode_unigram(self, word: str) -> list[int]:
        n = len(word)
        best = [-np.inf] * (n + 1)
        best[0] = 0.0
        last, back = [-1] * (n + 1), [0] * (n + 1)
        done = 0
        single = [False] * (n + 1)

        def unknown(upto: int) -> int:
            for end in range(done + 1, upto + 1):
                if not single[end] and best[end - 1] + self.worst > best[end]:
                    best[end], last[end], back[end] = best[end - 1] + self.worst, -1, end - 1
            return max(done, upto)

        for end, (i, size) in self.automaton.iter(word):
            end += 1
            done = unknown(end - 1)
            if size == 1:
                single[end] = True
            score = best[end - size] + self.scores[i]
            if score > best[end] or best[end] == -np.inf:
                best[end], last[end], back[end] = score, i, end - size
        done = unknown(n)
        return self._path(word, last, back)

    def _path(self, word: str, last: list[int], back: list[int]) -> list[int]:
        out: list[list[int]] = []
        at = len(word)
        while at:
            i, before = last[at], back[at]
            out.append([i] if i >= 0 else self._unknown_char(word[before]))
            at = before
        return [i for part in reversed(out) for i in part]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; null and empty have none."""
        if not text:
            return np.empty(0, np.uint32)
        marked = text.replace(" ", BLANK)
        words = self.words(BLANK + marked if self.prefix else marked)
        k = self.cache.numbers(words, lambda new: [self.encode_word(words[i]) for i in new])
        return self.cache.gather(k)[0]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_kept: dict[int, PieceModel] = {}


def piece_model(raw: bytes) -> PieceModel:
    """This process's model of that file's content."""
    key = zlib.crc32(raw)
    if key not in _kept:
        _kept[key] = PieceModel(raw)
    return _kept[key]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text; null and empty texts have no ids.

    Rows of null or repeated doc_id are encoded like any other; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(_model_file(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 512):
                ids = [m.encode(t) for t in texts[k : k + 512]]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.array(np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(ids)), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    model = encoded.sparkSession.sparkContext.broadcast(_model_file(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model.value)
        for batch in batches:
            texts = [None if x is None else m.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Encodes every whole text, decodes the ids and compares: doc_id, n_ids, ids_crc32, decoded_crc32, same.

    ids_crc32 is over the ids as little-endian unsigned 32-bit numbers, decoded_crc32
    over the decoded text in UTF-8; both need no ids or texts to leave the task.
    """
    model = docs.sparkSession.sparkContext.broadcast(_model_file(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model.value)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = m.encode(text)
                back = m.decode(ids)
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode()), back == (text or "")))
            cols = zip(*rows) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "same"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, same boolean"
    )


def _model_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
