"""Vectors by content: what is embedded is keyed by a hash of its text, so equal texts are encoded once and a second run encodes what changed.

Folder: one for each encoder's name, in it a folder for each block that was written
(digest, v). Encoding runs in Arrow batches; the encoder is loaded once by each Python
worker. A block is a job of its own, so a run that breaks off keeps the blocks it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.functions import text as T
from quillspark.session import discard, materialize

#: Texts of a block; some minutes of a neural encoder's work on a cluster.
BLOCK_TEXTS = 200_000
#: Texts that the encoder gets at once.
BATCH_TEXTS = 64
Encoder = Callable[[Sequence[str]], "np.ndarray"]


def digest_of(text: Column | str) -> Column:
    """The key of a text; null and empty texts have one too."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


class EmbeddingStore:
    """Vectors at ``path`` of the encoder that is called ``name``; another name is another store.

    load: gives the encoder, a function of texts to a matrix; it runs in the workers.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, load: Callable[[], Encoder], batch: int = BATCH_TEXTS):
        self.spark, self.path, self.load, self.batch = spark, f"{path.rstrip('/')}/encoder={name}", load, batch

    def stored(self) -> DataFrame:
        """(digest, v) of all texts that have been encoded; one that two runs encoded at once is there once for each."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        blocks = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
        # a block without its success mark broke off
        whole = [b.toString() for b in blocks if fs.exists(jvm.org.apache.hadoop.fs.Path(b, "_SUCCESS"))]
        reader = self.spark.read.schema("digest string, v array<float>")
        return reader.parquet(*whole) if whole else self.spark.createDataFrame([], "digest string, v array<float>")

    def add(self, texts: DataFrame, text: str = "text", block: int = BLOCK_TEXTS) -> int:
        """Encodes the texts that aren't stored yet; returns how many those are."""
        mine = texts.select(digest_of(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["digest"])
        missing = materialize(mine.join(self.stored().select("digest"), "digest", "left_anti"), "texts")
        n = missing.count()
        blocks = -(-n // block)
        for k in range(blocks):
            part = missing if blocks == 1 else missing.where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == k)
            self._encoded(part).write.parquet(f"{self.path}/block={uuid.uuid4().hex}")
        discard(missing)
        return n

    def _encoded(self, rows: DataFrame) -> DataFrame:
        load, size = self.load, self.batch

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = None
            for held in batches:
                encode = load() if encode is None else encode
                for a in range(0, len(held), size):
                    part = held.iloc[a : a + size]
                    v = np.asarray(encode(part["text"].tolist()), np.float32)
                    yield pd.DataFrame({"digest": part["digest"].to_numpy(), "v": list(v)})

        return rows.select("digest", "text").mapInPandas(run, "digest string, v array<float>")

    def vectors(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """Rows with the vector of their text in ``v``; null for texts that aren't stored."""
        known = self.stored().groupBy("digest").agg(F.first("v").alias("v"))
        return rows.withColumn("digest__", digest_of(text)).join(known.withColumnRenamed("digest", "digest__"), "digest__", "left").select(*rows.columns, "v")

    def embedded(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """Rows with their vectors, after what is missing has been encoded: for a corpus, or for queries that come again."""
        self.add(rows, text)
        return self.vectors(rows, text)


def hashed_words(dimensions: int = 256) -> Callable[[], Encoder]:
    """An encoder without a model: counts of words, and of pairs of ideographs, by their hash, with a sign by another bit of it."""
    import re
    import zlib

    token = re.compile(T.TOKEN)

    def load() -> Encoder:
        def encode(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions), np.float32)
            for row, text in zip(out, texts):
                for t in token.findall(text.lower()):
                    for part in [t[k : k + 2] for k in range(max(1, len(t) - 1))] if "一" <= t[0] <= "鿿" else [t]:
                        h = zlib.crc32(part.encode())
                        row[(h >> 1) % dimensions] += 1 - 2 * (h & 1)
            return out

        return encode

    return load
