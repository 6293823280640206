"""Streams: documents that arrive are indexed as they come, and sessions keep their last turns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.streaming.segments import SegmentedIndex


def index_stream(docs: DataFrame, path: str, checkpoint: str, key: str = "doc_id", body: str = "text") -> StreamingQuery:
    """Adds arriving documents to the segmented index at ``path``, a segment for each batch.

    A batch that is repeated after a failure is known by its name and counts once; a
    document that comes again replaces what it was.
    """
    kind = dict(docs.dtypes)[key]

    def add(batch: DataFrame, number: int) -> None:
        SegmentedIndex(batch.sparkSession, path, key_type=kind).add(batch, f"batch-{number}", key, text=body)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed_stream(spark: SparkSession, path: str, kind: str = "long") -> tuple[DataFrame, DataFrame]:
    """(id, dl, term, tf) and (id, dl) of the documents that count now."""
    postings, lengths = SegmentedIndex(spark, path, key_type=kind).alive()
    return postings.join(lengths, ["doc_id", "id"]).select("id", "dl", "term", "tf"), lengths.select("id", "dl")


def search_stream(spark: SparkSession, path: str, terms: DataFrame, k: int, kind: str = "long") -> DataFrame:
    """The BM25 top ``k`` of queries (query_id, term, qtf) over what has been indexed so far."""
    return SegmentedIndex(spark, path, key_type=kind).search(terms, k)


def parse_stream(files: DataFrame, parse, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what ``parse`` (a function of a batch of files) gives to a table; a file that was seen is not parsed again."""
    return files.writeStream.foreachBatch(lambda batch, n: parse(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_turns(turns: DataFrame, rounds: int = 6) -> DataFrame:
    """conv_id, history: the last ``rounds`` turns of each conversation after every batch; state is bounded by ``rounds``."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else []
        for batch in batches:
            rows = batch.sort_values("turn")
            kept += [[int(n), r, t or ""] for n, r, t in zip(rows["turn"], rows["role"], rows["text"].where(rows["text"].notna(), None))]
        kept = sorted(kept, key=lambda t: t[0])[-rounds:]
        state.update((json.dumps(kept),))
        yield pd.DataFrame({"conv_id": [key[0]], "history": ["\n".join(f"{r}: {t}" for _, r, t in kept)]})

    return turns.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, history string", "kept string", "update", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type, with late rows dropped after ``late``."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n, total of each user's events that follow one another within ``gap``; ``end`` is a gap after the last.

    On a stream a session is closed, and comes out in append mode, once the watermark
    has passed its end; rows later than that are dropped. Rows without a time take no part.
    """
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
