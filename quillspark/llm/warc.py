"""WARC archives: written as one gzip member per record, read back by a salvaging reader.

The reader walks an archive member by member (or, uncompressed, version line by version
line). Where a member does not inflate, or a record's header, length or digest does not
hold, it searches for the next valid member or version line, goes on from there, and logs
the bytes in between as a quarantined gap. What a member holds is searched in the same
way, also the part that inflated before an error.

Records of any size are read. What is longer than ``HELD`` is never held to be judged:
its end mark and digest are read through first, in a plain file by seeking, in a member
by inflating it again; a member of many records is parsed as it inflates. So a record
whose payload the caller keeps is held whole, and nothing else is.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.session import materialize, new_path

VERSION = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Bytes after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes that the reader asks for at once; a record's headers must end within as many.
CHUNK = 1 << 20
#: Bytes of a record, of a member's content or of a member up to which it is held to be judged.
HELD = 8 << 20
#: Revisits up to which their list is broadcast (16 bytes each).
BROADCAST_ROWS = 200_000
#: Parts of a payload's pages beyond that.
SALTS = 16
GZIP = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/\d")
END = b"\r\n\r\n"
#: Bytes that are inflated at once where a member is damaged.
STEP = 4096
DATE = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
RECORDS = "archive string, place long, bytes long, status string, headers map<string,string>, payload binary"


def digest(payload: bytes) -> str:
    """Bare upper-case base 32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(payload: bytes, headers: dict[str, str]) -> bytes:
    """A record with its block; Content-Length is added."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return VERSION + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}" if not path.startswith("file:") else path)


class Found(NamedTuple):
    """A block that isn't kept."""

    size: int
    digest: str


class _Bytes:
    """A window on a stream: what was read from ``at`` on and not yet dropped. shared: other windows read the stream too."""

    def __init__(self, stream, at: int = 0, shared: bool = False):
        self.stream, self.at, self.held, self.ended, self.shared = stream, at, b"", False, shared

    def fill(self, n: int) -> bool:
        """Whether ``n`` bytes are held, after reading on if need be."""
        if len(self.held) >= n:
            return True
        parts, size = [self.held], len(self.held)
        if self.shared and self.stream.tell() != self.at + size:
            self.stream.seek(self.at + size)
        while size < n and not self.ended:
            more = self.stream.read(CHUNK)
            self.ended = not more
            parts.append(more)
            size += len(more)
        self.held = b"".join(parts)
        return size >= n

    def drop(self, n: int) -> None:
        self.held = self.held[n:]
        self.at += n

    def seek(self, at: int) -> None:
        if self.at <= at <= self.at + len(self.held):
            self.drop(at - self.at)
        else:
            self.at, self.held, self.ended = at, b"", False

    def skip(self, n: int) -> bool:
        """Whether there are ``n`` bytes, which are dropped as they are read."""
        return self.through(n, lambda part: None)

    def through(self, n: int, take: Callable[[bytes], None]) -> bool:
        """Gives ``n`` bytes to ``take``, in parts, and drops them; whether there are so many."""
        while n > 0 and self.fill(1):
            part = self.held[:n]
            take(part)
            self.drop(len(part))
            n -= len(part)
        return n == 0


def _headers(head: bytes) -> dict[str, str] | None:
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        return None
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name:
            return None
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out if out.get("content-length", "").isdigit() else None


def _said(headers: dict[str, str]) -> str | None:
    """The SHA-1 that a record names for its block."""
    said = headers.get("warc-block-digest") or (headers.get("warc-payload-digest") if headers.get("warc-type") in ("response", "resource", "metadata") else None)
    return said[5:] if said and said.lower().startswith("sha1:") else None


def _parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, size) of the record that ``raw`` holds at ``at``, if it is whole and its digest holds."""
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    headers = _headers(raw[at:stop])
    if headers is None:
        return None
    n = int(headers["content-length"])
    block = raw[stop + 4 : stop + 4 + n]
    if len(block) < n or raw[stop + 4 + n : stop + 8 + n] != b"\r\n\r\n":
        return None
    said = _said(headers)
    if said is not None and said != digest(block):
        return None
    return headers, block, stop + 8 + n - at


class _Inflating:
    """The content of the gzip member that a window begins with, in pieces; a stream to read once.

    state: "whole" if it inflates to its end and its check holds, "short" if the stream
    ends before, "bad" for an error; the content is then what inflates up to there.
    used: bytes of the member that were inflated. Up to HELD of them stay in the window.
    """

    def __init__(self, window: _Bytes):
        self.window, self.start, self.used, self.state = window, window.at, 0, "whole"
        self.pieces = self._inflate()

    def read(self, n: int) -> bytes:
        return next(self.pieces, b"")

    def _inflate(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            at = self.start + self.used - self.window.at
            if at > HELD:
                self.window.drop(at)
                at = 0
            if not self.window.fill(at + 1):
                self.state = "short"
                return
            part = self.window.held[at : at + CHUNK]
            before, given = z.copy(), 0
            try:
                for piece in _pieces(z, part):
                    given += len(piece)
                    yield piece
            except zlib.error:
                self.state = "bad"
                yield from self._before_error(before, part, given)
                return
            self.used += len(part) - len(z.unused_data)

    def _before_error(self, z, part: bytes, given: int) -> Iterator[bytes]:
        """What inflates of a part before its error, less what was given already: in steps of bytes that get smaller."""
        at = 0
        for step in (STEP, 1):
            try:
                while at < len(part):
                    before = z.copy() if step > 1 else None
                    pieces = list(_pieces(z, part[at : at + step]))
                    for piece in pieces:
                        if len(piece) > given:
                            yield piece[given:]
                        given = max(0, given - len(piece))
                    at += step
            except zlib.error:
                z = before
        self.used += at


def _pieces(z, part: bytes) -> Iterator[bytes]:
    """What a part inflates to, at most CHUNK bytes at once."""
    more = True
    while more:
        piece = z.decompress(part, CHUNK)
        part = z.unconsumed_tail
        more = not z.eof and (bool(part) or len(piece) == CHUNK)
        if piece:
            yield piece


def _content(window: _Bytes, trusted: bool, keep: bool, size: int, again: Callable[[], _Bytes], clean: list[bool]) -> Iterator[tuple[dict[str, str], bytes | Found]]:
    """The valid records of ``size`` bytes of content, as they are read; ``clean`` gets False if there is anything else.

    again: the content from its beginning. trusted: records without a digest count too.
    """
    while window.fill(1):
        window.fill(min(CHUNK, size - window.at))
        stop = window.held.find(END)
        headers = _headers(window.held[:stop]) if stop >= 0 else None
        one = _record(window, stop, headers, keep, again) if headers and window.at + stop + 8 + int(headers["content-length"]) <= size else None
        if one is not None:
            if trusted or _said(headers) is not None:
                yield headers, one
            continue
        clean[0] = False
        start = 1
        while (line := VERSION_LINE.search(window.held, start)) is None and not window.ended:
            window.drop(max(0, len(window.held) - 8))
            window.fill(len(window.held) + 1)
            start = 0
        window.drop(line.start() if line else len(window.held))


def _record(window: _Bytes, stop: int, headers: dict[str, str], keep: bool, again: Callable[[], _Bytes]) -> bytes | Found | None:
    """The block of the record whose headers end at ``stop``, if it is whole and its digest holds; the window then stands behind it.

    A long one is read through ``again``, a second window on the same bytes, before it is taken.
    """
    n, said = int(headers["content-length"]), _said(headers)
    if stop + 8 + n <= HELD:
        window.fill(stop + 8 + n)
        found = _parse(window.held)
        if found is None:
            return None
        window.drop(found[2])
        return found[1] if keep else Found(n, digest(found[1]))
    other, sha = again(), hashlib.sha1()
    whole = other.skip(window.at + stop + 4 - other.at) and other.through(n, sha.update) and other.fill(4) and other.held[:4] == END
    shown = base64.b32encode(sha.digest()).decode()
    if not whole or said is not None and said != shown:
        return None
    window.drop(stop + 4)
    parts: list[bytes] = []
    window.through(n, parts.append if keep else lambda part: None)
    window.skip(4)
    return b"".join(parts) if keep else Found(n, shown)


def _resync(window: _Bytes, skip: int, plain: int = 0) -> None:
    """Drops bytes up to the next place, at least ``skip`` on, where a member or, at least ``plain`` on, a version line may begin; or all."""
    plain += window.at
    window.fill(skip + CHUNK)
    window.drop(min(skip, len(window.held)))
    while True:
        window.fill(CHUNK)
        line = VERSION_LINE.search(window.held, max(0, plain - window.at))
        found = [k for k in (window.held.find(GZIP), line.start() if line else -1) if k >= 0]
        if found:
            window.drop(min(found))
            return
        if window.ended:
            window.drop(len(window.held))
            return
        window.drop(len(window.held) - 8)


def _plain(window: _Bytes, most_bytes: int | None, keep: bool) -> tuple[dict[str, str], bytes | Found, int] | None:
    """(headers, block, size) of the valid plain record that the window begins with; the window stays or, for a long one, comes back."""
    window.fill(CHUNK)
    start, stop = window.at, window.held.find(END)
    headers = _headers(window.held[:stop]) if stop >= 0 else None
    if headers is None or most_bytes is not None and int(headers["content-length"]) > most_bytes:
        return None
    n, said = int(headers["content-length"]), _said(headers)
    if stop + 8 + n <= HELD:
        window.fill(stop + 8 + n)
        one = _parse(window.held)
        return None if one is None else (headers, one[1] if keep else Found(n, digest(one[1])), one[2])
    # the end mark first: an absurd length costs a seek
    window.seek(start + stop + 4 + n)
    whole = window.fill(4) and window.held[:4] == END
    sha, parts = hashlib.sha1(), []
    if whole:
        window.seek(start + stop + 4)
        window.through(n, sha.update)
        shown = base64.b32encode(sha.digest()).decode()
        if (whole := said is None or said == shown) and keep:
            window.seek(start + stop + 4)
            window.through(n, parts.append)
    window.seek(start)
    return (headers, b"".join(parts) if keep else Found(n, shown), stop + 8 + n) if whole else None


def salvage(stream, most_bytes: int | None = None, keep: bool = True) -> Iterator[tuple[int, int, str, dict[str, str] | None, bytes | Found | None]]:
    """(place, bytes, status, headers, block) of a stream that can seek: status ``ok``, or ``gap`` for quarantined bytes.

    An empty stream has no rows; one without any valid record is a single gap. Records
    of a gzip member have its place and size. A member that holds anything but valid
    records is also a gap, as what it loses has no place of its own in the stream. Of a
    member that fails its check, only records whose digest holds are valid. A plain
    record that claims more than ``most_bytes``, where that is given, is damage. Without
    ``keep`` a block is given as its size and digest.
    """
    window = _Bytes(stream, shared=True)
    gap = None
    while window.fill(1):
        start, size, state, clean = window.at, 0, "whole", [True]
        found: Iterator[tuple[dict[str, str], bytes | Found]] = iter(())
        if window.fill(3) and window.held[:3] == GZIP:
            member = _Inflating(window)
            parts, total = [], 0
            while piece := member.read(CHUNK):
                total += len(piece)
                parts = [*parts, piece] if total <= HELD else []
            size, state = member.used, member.state
            if total <= HELD:
                content = _Bytes(io.BytesIO(b"".join(parts)))
            else:
                window.seek(start)
                content = _Bytes(_Inflating(window))
            found = _content(content, state != "bad", keep, total, lambda start=start: _Bytes(_Inflating(_Bytes(stream, start, True))), clean)
        elif window.fill(8) and window.held[:5] == b"WARC/" and (one := _plain(window, most_bytes, keep)) is not None:
            found, size = iter([one[:2]]), one[2]
        some = False
        for headers, block in found:
            if gap is not None:
                yield gap, start - gap, "gap", None, None
                gap = None
            some = True
            yield start, size, "ok", headers, block
        window.seek(start)
        if some and state == "whole":
            if not clean[0]:
                yield start, size, "gap", None, None
            window.seek(start + size)
            continue
        gap = start if gap is None else gap
        # a stored member shows its records' text: those that were found are not read again
        _resync(window, 1, size if some else 0)
    if gap is not None and window.at > gap:
        yield gap, window.at - gap, "gap", None, None


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html, any others) into archives under ``path``.

    Returns the archives that count: path, records, bytes. A task writes under a name of
    its own and renames when it is done; archives of attempts that were lost are not
    listed. The payload is the html in UTF-8, null as empty. Of equal payloads of
    ``least_bytes`` and more the record of the largest page_id is a response, the others
    revisit it; rows that repeat that page_id are responses each, and rows of null
    page_id too, unless the payload has a page_id elsewhere.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # a digest of 160 bits tells payloads apart; only repeated ones have anything to revisit
    keys = rows.select("page_id", F.sha1("html").alias("d"), F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes)
    first = keys.groupBy("d").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    revisits = materialize(first, "payloads")
    joined = rows.withColumn("d", F.sha1("html"))
    if revisits.count() <= BROADCAST_ROWS:
        joined = joined.join(F.broadcast(revisits), "d", "left")
    else:  # the pages of one payload, empty ones above all, are met in several tasks
        salted = revisits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = joined.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["d", "salt"], "left")
    wanted = joined.select("page_id", "url", "html", F.when(~F.equal_null("page_id", "refers_to"), F.col("refers_to")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(path)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        state: dict = {}

        def close() -> None:
            if state:
                state["out"].close()
                fs.move(state["temporary"], state["final"])
                done.append((f"{path}/{state['final'].rpartition('/')[2]}", state["records"], state["bytes"]))
                state.clear()

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode("utf-8", "surrogatepass")
                kind = "response" if refers_to is None else "revisit"
                headers = {
                    "WARC-Type": kind,
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                    "WARC-Date": DATE,
                    "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url or ""),
                    "WARC-Payload-Digest": f"sha1:{digest(payload)}",
                    "X-Payload-Length": str(len(payload)),
                }
                if page_id is not None:
                    headers["X-Page-Id"] = str(page_id)
                if refers_to is not None:
                    headers |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-Id": str(refers_to)}
                raw = _gzip(record(payload if refers_to is None else b"", headers))
                if not state:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    state.update(temporary=f"{name}.open", final=name, records=0, bytes=0, out=fs.open_output_stream(f"{name}.open", compression=None))
                state["out"].write(raw)
                state["records"] += 1
                state["bytes"] += len(raw)
                if state["bytes"] >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return materialize(wanted.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records and gaps of the archives in column ``path``: RECORDS.

    Any file system that pyarrow opens; an archive is one task's work, read in chunks.
    Rows of status ``gap`` are the quarantine log. Null paths are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _filesystem(path)
                with fs.open_input_file(at) as stream:
                    held, size = [], 0
                    for place, n, status, headers, block in salvage(stream, keep=keep_payload):
                        if isinstance(block, Found):
                            headers = headers | {"found-length": str(block.size), "found-digest": block.digest}
                            block = None
                        held.append((path, place, n, status, None if headers is None else list(headers.items()), block))
                        size += len(block or b"") + 500
                        if size > 8 << 20:
                            yield _rows(held)
                            held, size = [], 0
                    if held:
                        yield _rows(held)

    # an archive per task: reading them costs far more than dealing out their names
    paths = archives.select("path").where("path IS NOT NULL").distinct()
    return paths.repartition(max(1, min(paths.count(), 4096))).mapInArrow(run, RECORDS)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=["archive", "place", "bytes", "status", "headers", "payload"])


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records and gaps of all files under ``path``; Spark lists them and reads none of their content for that."""
    return read_archives(spark.read.format("binaryFile").load(path).select("path"), keep_payload)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as archives, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest and length of a response are those of the block that was read, of a
    revisit those of the payload it stands for.
    """
    archives = write_pages(pages, new_path(pages.sparkSession, "warc"), least_bytes)
    found = read_archives(archives, keep_payload=False).where("status = 'ok'")
    header: Callable = lambda name: F.element_at("headers", name)
    response = header("warc-type") == "response"
    return found.select(
        header("x-page-id").cast("long").alias("page_id"),
        F.when(response, header("found-length")).otherwise(header("x-payload-length")).cast("long").alias("payload_bytes"),
        F.when(response, header("found-digest")).otherwise(F.substring_index(header("warc-payload-digest"), ":", -1)).alias("payload_digest"),
        header("warc-type").alias("record_type"),
        header("x-refers-to-page-id").cast("long").alias("refers_to"),
    )
