"""Conversations as state: the last turns of each, kept in a state store that a restart reads again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TURN = "turn long, role string, text string"
OUT = "conv_id long, n long, history string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastTurns(StatefulProcessor):
    """A bounded list of turns for each conversation, which is forgotten ``ttl`` milliseconds after its last turn; 0: never."""

    def __init__(self, rounds: int, ttl: int):
        self.rounds, self.ttl = rounds, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", TURN, self.ttl or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {t[0]: t for t in self.turns.get()} if self.turns.exists() else {}
        for batch in rows:
            for turn, role, text in batch[["turn", "role", "text"]].itertuples(index=False):
                new = (int(turn), role, text if isinstance(text, str) else "")
                held[new[0]] = max(held.get(new[0], new), new)  # a turn that repeats is one turn
        kept = [held[n] for n in sorted(held)][-self.rounds :]
        self.turns.put(kept)
        yield pd.DataFrame({"conv_id": [key[0]], "n": [len(kept)], "history": ["\n".join(f"{role}: {text}" for _, role, text in kept)]})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State that lies in files and not on the heap; ``sessions`` needs it, set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def sessions(turns: DataFrame, rounds: int = 6, ttl_ms: int = 0) -> DataFrame:
    """conv_id, n, history after each batch in which a conversation has turns (conv_id, turn, role, text): its last ``rounds`` turns by number.

    Turns may come late or again; rows of null conv_id or turn take no part. State is
    ``rounds`` turns a conversation.
    """
    whole = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text")
    return whole.groupBy("conv_id").transformWithStateInPandas(_LastTurns(rounds, ttl_ms), OUT, "Update", "ProcessingTime" if ttl_ms else "None")
