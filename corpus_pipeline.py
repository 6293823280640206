"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written and read again as the next one's ``docs``. All but the last return the
columns of ``documents``. No SQL can express the first stage's trees, the third's
MinHash values or the fourth's token ids, so the stages are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import jaccard, packing, passages, quality
from quillspark.session import ensure_importable, materialize, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; it learns from the labels of ``sf_dir`` that are not held out."""
    return quality.keep_good(docs, read(ensure_importable(spark), sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies."""
    ensure_importable(spark)
    return jaccard.keep_one(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand in an earlier document or place; n_chars follows the text."""
    ensure_importable(spark)
    return passages.cut_repeats(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    import public_tokenizers

    ensure_importable(spark)
    return packing.pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("substring dedup", passages_stage),
    ("best-fit packing", packing_stage),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
