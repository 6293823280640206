"""Small files of a folder merged by bins: first fit over blocks of groups, executed by plan and rows that meet in a cogroup.

Rows are written as one sorted file for each (day, lot, piece). Then the files of a day that
are small are packed into groups, largest first, each into the earliest-opened group that
can still hold it. Groups stand in blocks of about the square root of their possible
number, each with the largest room of its groups: a file looks through the blocks, then
inside the first that has room, in O(sqrt(n)) steps.

The plan has a row per file. It meets the files' rows by a join on (day, lot, piece), both
sides shuffled and sorted, so neither is broadcast or gathered; rows then go to their
group's task, which sorts by place in the group and writes one file, streaming. Merged
files are added to the folder before their sources are deleted, so no row is ever
missing from it; a lost executor costs its tasks only. File names pass through the driver
one by one, as they do in Spark's own commit; rows don't.

A null arrival time makes a day of its own (null), a null id hashes and prints as the
empty text, null and non-finite values add no cents. Repeated rows are rows. An empty
table gives no files and an empty result. Columns named day, lot or piece stay columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from quillspark.session import materialize, new_path

#: Shares of the table's rows: days of more than a LOT are parted, files of less than a SMALL are merged, up to a FULL.
LOT, SMALL, FULL = 150, 600, 500
REPORT = (
    "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, "
    "ids_sha256 string, columns string, path string, rewritten boolean"
)


class FirstFit:
    """Groups of a capacity in the order in which they were opened; each block caches the largest room of its groups."""

    def __init__(self, capacity: int, most_groups: int):
        self.capacity, self.width = capacity, max(1, math.isqrt(max(most_groups, 1)))
        self.rooms: list[list[int]] = []
        self.largest: list[int] = []

    def put(self, size: int) -> int:
        """The number of the group that takes ``size``: the first with room for it, or a new one."""
        block = next((k for k, room in enumerate(self.largest) if room >= size), None)
        if block is None:
            if not self.rooms or len(self.rooms[-1]) == self.width:
                self.rooms.append([])
                self.largest.append(0)
            block = len(self.rooms) - 1
            self.rooms[block].append(self.capacity)
        rooms = self.rooms[block]
        at = next(k for k, room in enumerate(rooms) if room >= size)
        rooms[at] -= size
        self.largest[block] = max(rooms)
        return block * self.width + at


def plan_merges(files: DataFrame, by: str, size: str, order: list[str], small: int, full: int) -> DataFrame:
    """Adds ``place__``, ``members__`` and ``first__`` (a struct of ``order``) to files: where each stands in its group, how many are in it, and which is first.

    Those of ``by`` with less than ``small`` rows are packed by descending size, then by
    ``order``; others are groups by themselves. A day's files are one pandas group: a row
    for each, not their rows.
    """

    def pack(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values([size, *order], ascending=[False, *[True] * len(order)], kind="stable").reset_index(drop=True)
        bins, groups = FirstFit(full, len(held)), {}
        for k, n in enumerate(held[size].tolist()):
            groups.setdefault(bins.put(n) if n < small else -1 - k, []).append(k)
        names = held[order].to_dict("records")
        place, members, first = [0] * len(held), [0] * len(held), [None] * len(held)
        for inside in groups.values():
            for at, k in enumerate(inside):
                place[k], members[k], first[k] = at, len(inside), names[inside[0]]
        return held.assign(place__=place, members__=members, first__=first)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    first = ", ".join(f"`{x}`: {dict(files.dtypes)[x]}" for x in order)
    return files.groupBy(by).applyInPandas(pack, f"{kinds}, place__ long, members__ long, first__ struct<{first}>")


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


class Folder:
    """A folder of Parquet files that lie by day, lot and piece; the three are names of folders, not columns of files."""

    def __init__(self, like: DataFrame, path: str, at: str, key: str, value: str):
        self.spark, self.path, self.columns = like.sparkSession, path, like.columns
        self.day, self.lot, self.piece = self.of = [_free(x, like.columns) for x in ("day", "lot", "piece")]
        self.at, self.key, self.value = at, key, value
        self.schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema), *(f"`{x}` long" for x in self.of)])

    def read(self) -> DataFrame:
        """The rows with ``file__``, their file, and ``row__``, their place in it."""
        found = self.spark.read.schema(self.schema).parquet(self.path)
        meta = found.metadataColumn("_metadata")
        return found.select("*", meta["file_path"].alias("file__"), meta["row_index"].alias("row__"))

    def add(self, rows: DataFrame, *order: str | Column) -> None:
        """Writes rows as a file for each (day, lot, piece), sorted by ``order``: a task has all rows of a file, in a sort that spills."""
        dealt = rows.repartition(*self.of).sortWithinPartitions(*self.of, *order)
        dealt.select(*self.columns, *self.of).write.partitionBy(*self.of).mode("append").option("maxRecordsPerFile", 0).parquet(self.path)

    def delete(self, files: Iterator[Row]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path
        fs = place(self.path).getFileSystem(conf)
        for (file,) in files:
            fs.delete(place(file), False)


def write_lots(rows: DataFrame, folder: Folder) -> int:
    """Writes the table's rows by day of arrival, lot and piece, a file each; returns how many rows there are.

    Only days of more than a 150th of the rows have several lots; there are fewer than 150 of them, so they are broadcast.
    """
    day, lot, piece = folder.of
    of_day = F.unix_date(F.col(folder.at).cast("date")).cast("long")
    days = materialize(rows.select(of_day.alias(day)).groupBy(day).agg(F.count("*").alias("rows__")), "days")
    total = days.agg(F.coalesce(F.sum("rows__"), F.lit(0))).first()[0]
    large = days.where(F.col("rows__") >= share(total, LOT)).select(F.col(day).alias("day__"), (1 + F.floor(F.col("rows__") / share(total, LOT))).alias("lots__"))
    h = F.crc32(F.coalesce(F.col(folder.key).cast("string"), F.lit("")).cast("binary"))
    keyed = rows.withColumns({day: of_day, "h__": h})
    keyed = keyed.join(F.broadcast(large), F.col(day).eqNullSafe(F.col("day__")), "left")
    keyed = keyed.withColumns(
        {lot: F.floor(F.col("h__") / 16) % F.coalesce("lots__", F.lit(1)), piece: F.least(F.col("h__") % 4, F.floor(F.col("h__") / 4) % 4)}
    )
    folder.add(keyed, folder.at, folder.key)
    return total


def share(total: int, parts: int) -> int:
    return 1 + total // parts


def merge(folder: Folder, plan: DataFrame) -> None:
    """Executes a plan: one file for each group of several, where its first source lay, then the sources go."""
    moved = plan.where("members__ > 1")
    day, lot, piece = folder.of
    steps = moved.select(F.col(day).alias("day__"), F.col(lot).alias("lot__"), F.col(piece).alias("piece__"), "place__", "first__")
    meet = F.col(day).eqNullSafe(F.col("day__")) & (F.col(lot) == F.col("lot__")) & (F.col(piece) == F.col("piece__"))
    rows = folder.read().join(steps.hint("merge"), meet).withColumns({lot: F.col("first__")[lot], piece: F.col("first__")[piece]})
    folder.add(rows, "place__", "row__")
    folder.delete(moved.select("file__").toLocalIterator())


def _digests():
    """Folds the rows of sorted files, batch by batch, to a row a file."""
    fields = ("day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "ids_sha256", "path")

    def run(batches):
        now, n, low, high, cents, digest = None, 0, None, None, 0, hashlib.sha256()

        def out():
            done = dict(zip(fields, (*now[:3], n, low, high, cents, digest.hexdigest(), now[3])))
            return pa.RecordBatch.from_pylist([done], pa.schema([*((x, pa.int64()) for x in fields[:7]), ("ids_sha256", pa.string()), ("path", pa.string())]))

        for batch in batches:
            path = batch.column("file")
            codes = path.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                of = (*(part.column(x)[0].as_py() for x in ("day", "lot", "piece")), part.column("file")[0].as_py())
                if now is None or of[3] != now[3]:
                    if now is not None:
                        yield out()
                    now, n, low, high, cents, digest = of, 0, None, None, 0, hashlib.sha256()
                ids = part.column("key").to_pylist()
                digest.update((b"," if n else b"") + ",".join("" if i is None else str(i) for i in ids).encode())
                n += b - a
                there = [i for i in ids if i is not None]
                low = min([*there, *([] if low is None else [low])], default=None)
                high = max([*there, *([] if high is None else [high])], default=None)
                x = np.floor(100 * part.column("value").to_numpy(zero_copy_only=False).astype(float) + 0.5)
                cents += sum(map(int, x[np.isfinite(x)]))
        if now is not None:
            yield out()

    return run


def report(folder: Folder, plan: DataFrame) -> DataFrame:
    """A row for each file of the folder as it is read back, with what the plan says of its sources."""
    rows = folder.read()
    names = rows.drop(*folder.of, "file__", "row__").columns
    slim = rows.select(*(F.col(x).alias(n) for x, n in zip(folder.of, ("day", "lot", "piece"))), F.col("file__").alias("file"), F.col("row__").alias("row"), F.col(folder.key).cast("long").alias("key"), F.col(folder.value).cast("double").alias("value"))
    dealt = slim.repartition("day", "lot", "piece").sortWithinPartitions("day", "lot", "piece", "file", "row")
    kinds = "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, ids_sha256 string, path string"
    files = dealt.drop("row").mapInArrow(_digests(), kinds)
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place__", F.concat_ws("-", folder.lot, folder.piece).alias("x")))), lambda s: s["x"]), ",")
    group = plan.groupBy(F.col(folder.day).alias("d__"), F.col("first__").alias("f__")).agg(named.alias("sources"), (F.max("members__") > 1).alias("rewritten"))
    group = group.select("d__", F.col("f__")[folder.lot].alias("l__"), F.col("f__")[folder.piece].alias("p__"), "sources", "rewritten")
    meet = F.col("day").eqNullSafe(F.col("d__")) & (F.col("lot") == F.col("l__")) & (F.col("piece") == F.col("p__"))
    found = files.join(group.hint("merge"), meet).withColumn("columns", F.lit(",".join(names)))
    return found.select(*(x.split()[0] for x in REPORT.split(", ")))


def compact_table(rows: DataFrame, at: str = "arrived_at", key: str = "click_id", value: str = "value") -> DataFrame:
    """Writes rows to a new folder, compacts it there and reports its final files."""
    folder = Folder(rows, new_path(rows.sparkSession, "compacted"), at, key, value)
    total = write_lots(rows, folder)
    if not total:
        return rows.sparkSession.createDataFrame([], REPORT)
    files = folder.read().groupBy(*folder.of).agg(F.count("*").alias("n_rows__"), F.first("file__").alias("file__"))
    plan = materialize(plan_merges(files, folder.day, "n_rows__", [folder.lot, folder.piece], share(total, SMALL), share(total, FULL)), "merges")
    merge(folder, plan)
    return report(folder, plan)
