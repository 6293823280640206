"""Session helpers: one place for configuration, the shared folder and table reads."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def get_spark(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(master)
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_importable(spark)


#: Rows that a Python worker gets at once; texts of some kB then take a few MB there and in the JVM.
BATCH_ROWS = 1000


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and bound the batches they get.

    On a cluster the package is shipped with ``--py-files``; then the path changes nothing.
    """
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(size)) > BATCH_ROWS:
        spark.conf.set(size, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent (local tests) is a temporary folder made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="quillspark-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{local}")
    return f"file://{local}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


#: Rows of a file of a table whose rows are counted before it is written.
ROWS_PER_FILE = 50_000


def materialize(df: DataFrame, name: str, rows: int | None = None, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor, and the
    optimiser sees the true size. rows: a bound of its rows, where one is known; then
    a small table is written by few tasks and not by one for each shuffle partition.
    """
    path = new_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // per_file)))).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


_written: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` gave, once what was made of them is written itself; others are left alone."""
    for table in tables:
        held, path = _written.pop(id(table), (None, ""))
        if held is not None and held() is table:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def numbered(rows: DataFrame, by: str, name: str, start: int = 1) -> DataFrame:
    """Adds ``name``: the place of each row in the order of ``by``, without a task that sees them all.

    Rows are sorted by range and written; a row's place is its place in its part and
    the sizes of the parts before it, of which there are as many as shuffle partitions.
    Rows that are equal in ``by`` have some order.
    """
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    held = materialize(rows.sort(by).withColumns({"part__": F.spark_partition_id(), "at__": inside}), "numbered")
    sizes = held.groupBy("part__").agg(F.count("*").alias("n__"))
    before = sizes.withColumn("before__", F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)))
    found = held.join(F.broadcast(before.select("part__", F.coalesce("before__", F.lit(0)).alias("before__"))), "part__")
    return found.withColumn(name, F.col("before__") + F.col("at__") + start).drop("part__", "at__", "before__")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
