"""Parsed documents, chunk files and JSON lines as Spark data sources, in batch and as streams.

``register(spark)`` makes the formats known to ``spark.read.format``, ``readStream`` and
SQL (``CREATE TEMPORARY VIEW v USING parsed_documents OPTIONS (path '...')``). Folders
are listed once, on the driver, and a file that several paths lead to is one file: no
rows are shuffled to drop it. Small files share a partition up to ``partitionBytes``.
The option ``only`` chooses files by path before any of them is opened. Conditions in a
query are not pushed into the listing: Spark 4.1 keeps the reader that one query's
conditions have narrowed for the next query of the same DataFrame, which loses rows.

A stream's offset is the place (time of change, path) of the last file in that order,
so it stays small however many files there were. Files younger than ``settleSeconds``
wait for a later batch; a file must not appear later than that with an older time. A
file that is changed comes again. A batch that is repeated reads the files of its offsets.

Options: path or several paths; glob, of file names; only, a regular expression that is
found in the path; partitionBytes; settleSeconds;
malformed: "raise" (the default) or "skip", which leaves out files or lines that are no
JSON object.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from fnmatch import fnmatchcase
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructType

from quillspark.sources.readers import BLOCK, METADATA

PARTITION_BYTES = 64 << 20
#: What opening a file counts in a partition's bytes.
OPEN_BYTES = 1 << 20
SETTLE_SECONDS = 2.0
#: Rows of a batch that a worker hands on.
BATCH_ROWS = 200


@dataclass(frozen=True)
class File:
    path: str
    changed: int  # nanoseconds since 1970
    size: int


@dataclass
class Files(InputPartition):
    held: tuple[File, ...]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}")


def list_files(paths: Iterable[str], glob: str) -> list[File]:
    """The files at or below ``paths`` whose name matches, each once, by path; names that begin with "_" or "." are left out. A path that isn't there raises."""
    from pyarrow import fs

    found: dict[str, File] = {}
    for path in paths:
        at, root = _filesystem(path)
        uri = path if "://" in path else f"file://{root}"
        prefix = uri.rstrip("/").removesuffix(root.rstrip("/"))
        info = at.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        below = [info] if info.type == fs.FileType.File else at.get_file_info(fs.FileSelector(root, recursive=True))
        for f in below:
            if f.type == fs.FileType.File and fnmatchcase(f.base_name, glob) and f.base_name[0] not in "_.":
                found[prefix + f.path] = File(prefix + f.path, f.mtime_ns or 0, f.size or 0)
    return sorted(found.values(), key=lambda f: f.path)


def shared_out(files: list[File], most: int) -> list[Files]:
    """Partitions of ``files`` in their order, each of at most ``most`` bytes or one file."""
    out: list[list[File]] = []
    room = 0
    for f in files:
        if not out or f.size + OPEN_BYTES > room:
            out.append([])
            room = most
        out[-1].append(f)
        room -= f.size + OPEN_BYTES
    return [Files(tuple(x)) for x in out]


def _typed(value: Any, kind: DataType) -> Any:
    """A JSON value as ``kind``, by the rules of Spark's own reader: what isn't a string becomes its JSON text, what doesn't fit null."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if isinstance(kind, StructType):
        return {f.name: _typed(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
    if isinstance(kind, ArrayType):
        return [_typed(x, kind.elementType) for x in value] if isinstance(value, list) else None
    if isinstance(kind, MapType):
        return [(k, _typed(x, kind.valueType)) for k, x in value.items()] if isinstance(value, dict) else None
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(kind, DoubleType):
        return float(value) if number else None
    if isinstance(kind, (IntegerType, LongType)):
        bits = 31 if isinstance(kind, IntegerType) else 63
        return value if number and isinstance(value, int) and -(1 << bits) <= value < 1 << bits else None
    return value if isinstance(kind, BooleanType) and isinstance(value, bool) else None


def _stem(path: str, suffix: str) -> str:
    return path.rpartition("/")[2].removesuffix(suffix)


def _object(text: str, where: str, skip: bool) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError as wrong:
        if skip:
            return None
        raise ValueError(f"malformed JSON in {where}: {wrong}") from None
    if isinstance(found, dict):
        return found
    if skip:
        return None
    raise ValueError(f"malformed JSON in {where}: not an object")


def _text(value: Any) -> str:
    return _typed(value, StringType()) or ""


def _parsed_rows(stream, path: str, skip: bool) -> Iterator[tuple]:
    """A row per file: doc_id (the source's name, else the file's), source, page_sizes, blocks."""
    if (doc := _object(stream.read().decode("utf-8"), path, skip)) is not None:
        name = re.sub(r"(?i)\.pdf$", "", _text(doc.get("source")).rpartition("/")[2])
        yield name or _stem(path, ".parsed.json"), doc.get("source"), doc.get("page_sizes"), doc.get("blocks")


def _chunk_rows(stream, path: str, skip: bool) -> Iterator[tuple]:
    """A row per chunk: doc_id (else the file's name), source, ord, chunk_id, text, metadata."""
    if (held := _object(stream.read().decode("utf-8"), path, skip)) is not None:
        doc_id = _stem(path, ".json") if held.get("doc_id") is None else held["doc_id"]
        chunks = held["chunks"] if isinstance(held.get("chunks"), list) else []
        for k, c in enumerate(chunks):
            if isinstance(c, dict):
                yield doc_id, _text(held.get("source")), k, c.get("id"), _text(c.get("text")), c.get("metadata")


def _line_rows(stream, path: str, skip: bool) -> Iterator[tuple]:
    """A row per line that isn't blank: line (from 0), record (its JSON text). Lines are read one by one."""
    import io

    for k, line in enumerate(io.TextIOWrapper(stream, encoding="utf-8")):
        if line.strip() and _object(line, f"{path}, line {k + 1}", skip) is not None:
            yield k, line.strip()


_PLACE = "path string, modified timestamp"
_BLOCK = f"struct<{', '.join(x.strip().replace(' ', ':', 1) for x in BLOCK.split(', '))}>"
#: Format: its columns, the files' names, what gives a file's rows.
FORMATS = {
    "parsed_documents": (f"{_PLACE}, doc_id string, source string, page_sizes array<struct<page:int,width:double,height:double>>, blocks array<{_BLOCK}>", "*.parsed.json", _parsed_rows),
    "chunk_files": (f"{_PLACE}, doc_id string, source string, ord int, chunk_id string, text string, metadata struct<{METADATA}>", "*.json", _chunk_rows),
    "json_lines": (f"{_PLACE}, line long, record string", "*.jsonl", _line_rows),
}


class _Reading:
    """What the batch and the stream reader share."""

    def __init__(self, name: str, options: dict[str, str], schema: StructType):
        _, glob, self.rows = FORMATS[name]
        self.schema = schema
        given = options.get("paths")
        self.paths = json.loads(given) if given else [options["path"]] if "path" in options else []
        if not self.paths:
            raise ValueError(f"{name} needs a path")
        self.glob = options.get("glob", glob)
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.settle = float(options.get("settleSeconds", SETTLE_SECONDS))
        malformed = options.get("malformed", "raise")
        if malformed not in ("raise", "skip"):
            raise ValueError(f'malformed is "raise" or "skip", not {malformed!r}')
        self.skip = malformed == "skip"
        self.only = re.compile(options["only"]) if "only" in options else None

    def files(self) -> list[File]:
        return [f for f in list_files(self.paths, self.glob) if self.only is None or self.only.search(f.path)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.schema)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
        kinds = [f.dataType for f in self.schema.fields[2:]]
        held: list[tuple] = []
        for f in partition.held:
            at, place = _filesystem(f.path)
            when = datetime.fromtimestamp(f.changed // 1000 / 1e6, timezone.utc)
            with at.open_input_stream(place, compression=None) as stream:
                for row in self.rows(stream, f.path, self.skip):
                    held.append((f.path, when, *map(_typed, row, kinds)))
                    if len(held) == BATCH_ROWS:
                        yield batch(held)
                        held = []
        if held:
            yield batch(held)


class BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return shared_out(self.files(), self.most) or [Files(())]


class StreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        """The last file that has settled; what it is now if there is none yet."""
        limit = time.time_ns() - int(self.settle * 1e9)
        last = max(((f.changed, f.path) for f in self.files() if f.changed <= limit), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = ((x["changed"], x["path"]) for x in (start, end))
        files = sorted(self.files(), key=lambda f: (f.changed, f.path))
        return shared_out([f for f in files if after < (f.changed, f.path) <= upto], self.most)

    def commit(self, end: dict) -> None:
        """Nothing is kept between batches but the offset, which Spark writes."""


class _JsonSource(DataSource):
    def schema(self) -> str:
        return FORMATS[self.name()][0]

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.name(), dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.name(), dict(self.options), schema)


class ParsedDocuments(_JsonSource):
    @classmethod
    def name(cls) -> str:
        return "parsed_documents"


class ChunkFiles(_JsonSource):
    @classmethod
    def name(cls) -> str:
        return "chunk_files"


class JsonLines(_JsonSource):
    @classmethod
    def name(cls) -> str:
        return "json_lines"


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats known to the session."""
    for source in (ParsedDocuments, ChunkFiles, JsonLines):
        spark.dataSource.register(source)
    return spark
