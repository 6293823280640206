"""Spelling variants by anagram hashing: words whose letter sums differ by one letter's power, then letters in order.

A word's key is the sum of a power of each letter's code point, so that anagrams share it
and one letter added, removed or exchanged changes it by a value that the letter alone
decides. Words are joined on the key less any one of their letters: a word of which one
letter is removed meets the shorter word's whole key, and two words of which one letter
is exchanged meet where each lacks its own. Anagram classes can be large, so the letters'
order takes part in the join: words one edit apart agree on the first half of what is
left, or on the second, and no group holds more than the words that share such a half.
``levenshtein`` verifies what meets.

Rows with a null text give no words; a null id counts as the empty text. Repeated rows
count once each. An empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.session import discard, materialize

MIN_LENGTH, MIN_COUNT, FORM_TIMES, TYPO_EVERY = 7, 2, 10, 31
#: The power of code points that keys add up, and the modulus of sums; what collides is verified.
POWER, MODULUS = 5, (1 << 61) - 1
#: Distinct words that a task holds before it hands its counts on.
HELD_WORDS = 200_000
#: Bytes of a text that are split into words at once.
PIECE = 1 << 22
#: Latin-1 bytes: letters stay, A-Z in lower case; anything else separates words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> Iterator[list[bytes]]:
    """The maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` in order, a byte per code point, in lists of bounded size."""
    raw = text.encode("latin-1", "replace").translate(_LETTERS)  # what Latin-1 lacks becomes "?", no letter
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def with_typo(prefix: int, run: bytes) -> bytes:
    """The run, less one letter where the hash of its document's id and itself says so. prefix: the crc32 of ``<id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % TYPO_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all texts: words of at least seven code points that occur at least twice.

    Each task adds its words up before they are shuffled, in dictionaries of bounded size.
    """

    def count(batches):
        held: Counter[bytes] = Counter()

        def out():
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix = zlib.crc32(f"{'' if key is None else key}:".encode("utf-8", "surrogatepass"))
                for part in runs(value or ""):
                    for run, n in Counter(part).items():
                        if len(run) >= MIN_LENGTH and len(word := with_typo(prefix, run)) >= MIN_LENGTH:
                            held[word] += n
                    if len(held) > HELD_WORDS:
                        yield out()
        yield out()

    counted = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    value = code
    for _ in range(POWER - 1):
        value = value * code
    return value


def signatures(words: DataFrame) -> DataFrame:
    """(sum, half, second, letter, word, n): each word's key whole (letter empty) and less each of its letters, with both halves of what is left.

    Of r letters that are left, words one edit apart share the first ceil(r / 2) or the last floor(r / 2) + 1.
    """
    letters = F.split("word", "")
    key = F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: (s + _value(c)) % MODULUS)
    less = F.transform(F.array_distinct(letters), lambda c: F.struct(F.pmod(F.col("key") - _value(c), F.lit(MODULUS)).alias("sum"), c.alias("letter")))
    each = words.withColumn("key", key).select("word", "n", F.explode(F.concat(F.array(F.struct(F.col("key").alias("sum"), F.lit("").alias("letter"))), less)).alias("s"))
    each = each.select("word", "n", "s.sum", "s.letter", F.explode(F.array(F.lit(False), F.lit(True))).alias("second"))
    left = F.length("word") - F.length("letter")
    first = F.ceil(left / 2).cast("int")
    half = F.when(F.col("second"), F.right("word", left - first + 1)).otherwise(F.left("word", first))
    return each.select("sum", F.xxhash64("second", half).alias("half"), "second", "letter", first.alias("first"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): the pairs of words (word, n) that differ by exactly one inserted, deleted or replaced code point, both ways round.

    A pair meets in one sum only; where both halves agree, it counts in the first.
    """
    s = signatures(words)
    a, b = s.alias("a"), s.alias("b")
    once = ~F.col("a.second") | (F.left(F.col("a.word"), F.col("a.first")) != F.left(F.col("b.word"), F.col("b.first")))
    meet = (F.col("a.sum") == F.col("b.sum")) & (F.col("a.half") == F.col("b.half")) & (F.col("a.second") == F.col("b.second"))
    pairs = a.join(b, meet & (F.col("a.letter") != F.col("b.letter")) & (F.col("a.word") < F.col("b.word")) & once & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    way = lambda x, y: F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{x}.n").alias("n"), F.col(f"{y}.word").alias("other"), F.col(f"{y}.n").alias("other_n"))
    return pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).select("p.*")


def follow(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): from each word of forms (word, form) along forms to the last. most: no chain is longer.

    Each round doubles the steps taken, so a few joins do.
    """
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(most, 1)))):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("on"))
        new = materialize(at.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root")), "roots")
        discard(at)
        at = new
    return at


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    A word's form is its near word of largest n (ties: the smallest), where that is at
    least ten times the word's own; its root is what forms lead to. Along a chain of
    forms n grows tenfold at each step, which bounds its length.
    """
    words = materialize(count_words(docs, doc_id, text), "words")
    best = F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), F.col("other")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = F.col("best.other_n") >= FORM_TIMES * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.other_n")).alias("form_n")
    )
    found = materialize(found, "variants")
    largest = words.agg(F.max("n")).first()[0] or MIN_COUNT
    steps = next(k for k in range(64) if MIN_COUNT * FORM_TIMES ** (k + 1) > largest)
    roots = follow(found.where("form IS NOT NULL"), steps)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
