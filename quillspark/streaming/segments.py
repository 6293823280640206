"""A search index of immutable segments: documents come, change and go, and a search equals one over a rebuilt index.

Every change is a numbered segment with its chunks' tokens or its tombstones. A
document's newest segment decides: its earlier versions and, after a tombstone, all of
them are dead. What is alive is merged when it is read; ``compact`` writes it as one
segment. A manifest for each generation names the segments that count, so a change is
seen whole or not at all, and a change that is repeated under its name counts once.

A chunk's postings stay together, in one row and one string: only ``add`` shuffles texts, to find rows
that repeat an id; merging and searching leave them where they are, but for a merge of
more superseded documents than are broadcast.

Folders: postings/segment=N (doc_id, id, dl, tokens), tombstones/segment=N (doc_id),
manifests/generation=G (segment, name, kind).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.functions import text as T
from quillspark.operators import lexical
from quillspark.session import discard, materialize

_MANIFEST = "segment long, name string, kind string"
#: Superseded or deleted documents up to which they are broadcast (some 100 bytes each).
BROADCAST_GONE = 1_000_000


class SegmentedIndex:
    """An index at ``path``. One writer at a time: a second one that commits the same generation fails.

    Units of change are documents (doc_id), units of search their chunks (id); without
    chunks both are the same. segment: splits runs of ideographs.
    """

    def __init__(self, spark: SparkSession, path: str, segment: Callable[[Column], Column] | None = None, key_type: str = "long", id_type: str | None = None):
        self.spark, self.path, self.segment = spark, path.rstrip("/"), segment
        self.key_type, self.id_type = key_type, id_type or key_type
        self._stats: tuple[int, DataFrame, DataFrame, float, list[DataFrame]] | None = None
        if self._files("lengths"):
            raise ValueError(f"{self.path} has postings by term, of an earlier layout: add its documents to a new index")

    # ---- manifests

    def _files(self, folder: str) -> list[str]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def generation(self) -> int:
        """The newest generation, 0 for an empty index. A manifest without its success mark doesn't count."""
        found = sorted((int(n.split("=")[1]) for n in self._files("manifests") if n.startswith("generation=")), reverse=True)
        return next((g for g in found if "_SUCCESS" in self._files(f"manifests/generation={g}")), 0)

    def manifest(self, generation: int | None = None) -> list[tuple[int, str, str]]:
        g = self.generation() if generation is None else generation
        if not g:
            return []
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/generation={g}").collect()
        return sorted((r.segment, r.name, r.kind) for r in rows)

    def _commit(self, generation: int, rows: list[tuple[int, str, str]]) -> None:
        # a generation that lacks its success mark was never seen
        mode = "overwrite" if "_SUCCESS" not in self._files(f"manifests/generation={generation}") else "errorifexists"
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode(mode).parquet(f"{self.path}/manifests/generation={generation}")

    def _change(self, name: str | None, kind: str, write: Callable[[int], None]) -> int:
        """Writes a segment and commits it; one of that name that was committed is not written again. Returns its number."""
        g = self.generation()
        held = self.manifest(g)
        if name is not None and (done := [n for n, known, _ in held if known == name]):
            return done[0]
        number = max([n for n, _, _ in held], default=0) + 1
        write(number)
        self._commit(g + 1, [*held, (number, name or f"change-{number}", kind)])
        return number

    # ---- changes

    def add(self, docs: DataFrame, name: str | None = None, doc_id: str = "doc_id", id: str | None = None, text: Column | str = "text") -> int:
        """New documents, or new versions of known ones: all chunks of a document come at once.

        Of rows that repeat an id in one call, that of the greatest text counts. A null id or text takes no part in a search.
        """
        body = F.col(text) if isinstance(text, str) else text
        rows = docs.select(F.col(doc_id).cast(self.key_type).alias("doc_id"), F.col(id or doc_id).cast(self.id_type).alias("id"), body.alias("text")).where("doc_id IS NOT NULL AND id IS NOT NULL")
        # texts go to their key's task as they are: one shuffle, and one sort for the aggregation
        rows = rows.repartition("doc_id", "id").groupBy("doc_id", "id").agg(F.max("text").alias("text"))
        tokens = rows.select("doc_id", "id", T.tokens("text", self.segment).alias("tokens"))
        return self._change(name, "add", lambda n: self._write(n, tokens.select("doc_id", "id", F.size("tokens").alias("dl"), lexical.joined("tokens").alias("tokens"))))

    def delete(self, ids: DataFrame, name: str | None = None, doc_id: str = "doc_id") -> int:
        """All chunks of these documents go, e.g. those of a source; ids that aren't known do nothing."""
        gone = ids.select(F.col(doc_id).cast(self.key_type).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        return self._change(name, "delete", lambda n: gone.write.mode("overwrite").parquet(f"{self.path}/tombstones/segment={n}"))

    def _write(self, n: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/postings/segment={n}")

    def compact(self) -> int:
        """What is alive as one segment, under the names of those that it replaces; their folders stay until ``vacuum``."""
        g = self.generation()
        held = self.manifest(g)
        if len(held) < 2:
            return g
        number = held[-1][0] + 1
        rows, gone = self._alive(held)
        self._write(number, rows)
        discard(*gone)
        # names of changes are kept, so that a change that comes again is known
        self._commit(g + 1, [(number, f"compacted-{number}", "add"), *((n, name, "merged") for n, name, _ in held)])
        return g + 1

    def vacuum(self) -> None:
        """Deletes segments and manifests that the newest generation doesn't use."""
        g = self.generation()
        used = {n for n, _, kind in self.manifest(g) if kind != "merged"}
        jvm = self.spark._jvm
        for folder, keep in (("postings", used), ("tombstones", used), ("manifests", {g})):
            for found in self._files(folder):
                if "=" in found and int(found.split("=")[1]) not in keep:
                    at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/{found}")
                    at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    # ---- reading

    def _read(self, folder: str, numbers: list[int], fields: str) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], f"{fields}, segment long")
        reader = self.spark.read.schema(f"{fields}, segment long").option("basePath", f"{self.path}/{folder}")
        return reader.parquet(*(f"{self.path}/{folder}/segment={n}" for n in numbers))

    def _alive(self, held: list[tuple[int, str, str]]) -> tuple[DataFrame, list[DataFrame]]:
        """doc_id, id, dl, tokens of the newest version of each document that no later tombstone names; and what it wrote for that."""
        added, deleted = [n for n, _, k in held if k == "add"], [n for n, _, k in held if k == "delete"]
        rows = self._read("postings", added, f"doc_id {self.key_type}, id {self.id_type}, dl int, tokens string")
        written = []
        if len(added) > 1 or deleted:
            named = rows.select("doc_id", "segment").unionByName(self._read("tombstones", deleted, f"doc_id {self.key_type}"))
            newest = named.groupBy("doc_id").agg(F.min("segment").alias("first"), F.max("segment").alias("newest")).where("newest > first")
            gone = materialize(newest.select("doc_id", "newest"), "gone")
            written.append(gone)
            if n := gone.count():
                few = F.broadcast if n <= BROADCAST_GONE else (lambda x: x)
                rows = rows.join(few(gone), (rows["doc_id"] == gone["doc_id"]) & (rows["segment"] < gone["newest"]), "left_anti")
        return rows.select("doc_id", "id", "dl", "tokens"), written

    def alive(self) -> tuple[DataFrame, DataFrame]:
        """Postings (doc_id, id, term, tf) and lengths (doc_id, id, dl) of all documents that count now."""
        rows, _ = self._alive(self.manifest())
        terms = rows.select("doc_id", "id", F.explode(lexical.parted("tokens")).alias("term"))
        return terms.groupBy("doc_id", "id", "term").agg(F.count("*").alias("tf")), rows.select("doc_id", "id", "dl")

    def _statistics(self) -> tuple[DataFrame, DataFrame, float]:
        """(id, tokens) of what is alive, its term statistics, written once for each generation, and its average length."""
        g = self.generation()
        if self._stats is None or self._stats[0] != g:
            if self._stats is not None:
                discard(self._stats[2], *self._stats[4])
            rows, written = self._alive(self.manifest(g))
            average = rows.agg(F.sum("dl") / F.count("*")).first()[0] or 1.0
            self._stats = (g, rows.select("id", "tokens"), materialize(lexical.term_stats(rows.select("id", lexical.parted("tokens").alias("tokens"))), "terms"), average, written)
        return self._stats[1:4]

    def search(self, terms: DataFrame, k: int) -> DataFrame:
        """query_id, rank, id, score: the BM25 top ``k`` of queries (query_id, term, qtf) over what is alive."""
        rows, stats, average = self._statistics()
        return lexical.best(rows, terms, k, stats=(stats, average))

    def ask(self, queries: DataFrame, k: int, key: str = "query_id", text: str = "query") -> DataFrame:
        return self.search(lexical.query_terms(queries, key, text, self.segment), k)


def upload(index: SegmentedIndex, classified: DataFrame, sources: DataFrame, size: int = 512, overlap: int = 100, name: str | None = None) -> DataFrame:
    """Blocks of new or changed reports to searchable chunks in one call: chunks of every kind, docstore records, a segment of those that are indexed.

    Returns the docstore's records. The index's ids are chunk ids; tables are searched with their surroundings and captions.
    """
    from quillspark.operators import index as records_of, typed

    records = materialize(records_of.docstore_records(typed.chunk_documents_typed(classified, sources, size, overlap)), "records")
    body = lexical.table_context(F.col("text"), F.col("chunk_type"), F.col("context"), F.col("caption"))
    index.add(records.where("indexed"), name, "doc_id", "chunk_id", body)
    return records
