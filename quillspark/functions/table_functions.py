"""Table functions for SQL: ``SELECT * FROM pack_units(TABLE(units) PARTITION BY (doc_id, section, subsection) ORDER BY (ord), 512, 100)``.

Each partition is one section: its rows arrive in order, its chunks leave when it ends.
``register`` makes them known to a session.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from quillspark.operators import chunking

PACKED = "doc_id string, section string, subsection string, chunk_no int, text string, block_ids array<string>, page_start int, page_end int, tokens long"


@udtf(returnType=PACKED)
class PackUnits:
    """Chunks of units (doc_id, section, subsection, page, block_id, text), packed as ``chunking.chunk_sections`` packs them."""

    def __init__(self):
        self.of, self.units, self.size, self.overlap = None, [], 512, 100

    def eval(self, row: Row, size: int = 512, overlap: int = 100):
        self.of = (None if row["doc_id"] is None else str(row["doc_id"]), row["section"], row["subsection"])
        self.size, self.overlap = size, overlap
        for n, part in enumerate(chunking.split_long(row["text"], size) if row["text"] else []):
            self.units.append((part, [row["block_id"] if n == 0 else f"{row['block_id']}#part{n + 1}"], int(row["page"])))

    def terminate(self):
        for k, (text, ids, first, last) in enumerate(chunking.pack_units(self.units, self.size, self.overlap)):
            yield (*self.of, k, text, ids, first, last, chunking.count_tokens(text))


@udtf(returnType="piece_no int, piece string, tokens long")
class SplitText:
    """A text as pieces of at most ``size`` tokens; null and empty texts have none."""

    def eval(self, text: str, size: int):
        for k, piece in enumerate(chunking.split_long(text, size) if text else []):
            yield k, piece, chunking.count_tokens(piece)


def register(spark: SparkSession) -> None:
    spark.udtf.register("pack_units", PackUnits)
    spark.udtf.register("split_pieces", SplitText)
