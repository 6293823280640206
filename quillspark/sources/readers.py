"""Scans: parsed documents, chunk files, docstores, evaluation sets, checkpoints and index catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

BLOCK = "id string, type string, page int, bbox array<double>, text string, meta map<string,string>"
PARSED = f"source string, method string, page_sizes array<struct<page:int,width:double,height:double>>, blocks array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in BLOCK.split(', '))}>>, _corrupt_record string"
METADATA = "doc_id:string,source:string,page_start:int,page_end:int,section:string,subsection:string,block_ids:array<string>,chunk_type:string,table_id:string,caption:string,bm25_context:string"
CHUNKS = f"doc_id string, source string, chunk_config struct<chunk_size_tokens:int,overlap_tokens:int>, chunks array<struct<id:string,text:string,metadata:struct<{METADATA}>>>, _corrupt_record string"
DOCSTORE = "faiss_id long, docstore_id string, chunk_id string, doc_id string, text string, embedding_text string, chunk_type string, indexed boolean, source_file string, source_pdf string"
CHECKPOINT = "qid string, query_type string, metrics map<string,double>, timestamp string"
PARTS = ("docstore", "vectors", "build_meta")


def _files(spark: SparkSession, glob: str):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)


def disjoint(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The paths, patterns expanded, less those that repeat or lie below another: no file is read twice, and nothing is shuffled for it."""
    jvm, found = spark._jvm, set()
    for path in [paths] if isinstance(paths, str) else paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        met = fs.globStatus(at)
        # what isn't there is left for the reader to name
        found |= {f.getPath().toString() for f in met} if met else {fs.makeQualified(at).toString()}
    below = lambda p: any(p[:k] in found for k, c in enumerate(p) if c == "/" and k)
    return sorted(p for p in found if not below(p))


def _stem(path, suffix: str):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), suffix, "")


def parsed_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """doc_id and the fields of every ``*.parsed.json`` below ``paths``, each file once. A malformed file raises."""
    rows = _files(spark, "*.parsed.json").schema(PARSED).option("multiLine", True).option("mode", "FAILFAST").json(disjoint(spark, paths))
    rows = rows.withColumn("file__", F.input_file_name())
    path = F.col("file__")
    source = F.regexp_replace(F.element_at(F.split(F.coalesce("source", F.lit("")), "/"), -1), r"(?i)\.pdf$", "")
    return rows.select(F.coalesce(F.nullif(source, F.lit("")), _stem(path, r"\.parsed\.json$")).alias("doc_id"), "source", "page_sizes", "blocks")


def document_blocks(parsed: DataFrame) -> DataFrame:
    """A row per block in its order: doc_id, ord, block_id, type, page, bbox, text; missing values become defaults."""
    rows = parsed.select("doc_id", F.posexplode("blocks").alias("ord", "b"))
    box = F.coalesce("b.bbox", F.array(*[F.lit(0.0)] * 4))
    return rows.select("doc_id", "ord", F.coalesce("b.id", F.lit("")).alias("block_id"), F.coalesce("b.type", F.lit("text")).alias("type"), F.coalesce("b.page", F.lit(0)).alias("page"), box.alias("bbox"), F.coalesce("b.text", F.lit("")).alias("text"))


def chunk_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row per chunk of every JSON chunk file: file, doc_id (else the file's name), ord, chunk_id, text, metadata."""
    rows = _files(spark, "*.json").schema(CHUNKS).option("multiLine", True).json(disjoint(spark, paths)).withColumn("file", F.input_file_name())
    rows = rows.select("file", F.coalesce("doc_id", _stem(F.col("file"), r"\.json$")).alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.posexplode_outer("chunks").alias("ord", "c"))
    return rows.where("c IS NOT NULL").select("file", "doc_id", "source", "ord", F.col("c.id").alias("chunk_id"), F.coalesce("c.text", F.lit("")).alias("text"), "c.metadata")


def docstore(spark: SparkSession, path: str) -> DataFrame:
    """A docstore in JSON lines; blank lines are skipped, a malformed one raises."""
    return spark.read.schema(DOCSTORE).option("mode", "FAILFAST").json(path).where("docstore_id IS NOT NULL")


def indexed_records(store: DataFrame, expected: int | None = None) -> DataFrame:
    """Records with a vector, by vector id; raises if there are not ``expected`` of them."""
    rows = store.where("indexed AND faiss_id IS NOT NULL")
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} records have a vector, {expected} were expected")
    return rows


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An evaluation set: one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_object(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A sidecar: one JSON object in a file."""
    read = spark.read.option("multiLine", True)
    return (read.schema(schema) if schema else read).json(path)


def records_of(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The records of result files, objects with an array under ``key``; raises where a file has none."""
    rows = spark.read.option("multiLine", True).schema(f"{key} array<struct<{schema}>>").json(path).withColumn("file", F.input_file_name())
    if (bad := rows.where(F.col(key).isNull()).select("file").first()) is not None:
        raise ValueError(f"{bad.file} has no list of {key}")
    return rows.select(F.posexplode(key).alias("ord", "r")).select("ord", "r.*")


def page_sizes(parsed: DataFrame) -> DataFrame:
    """doc_id, page, width, height of the pages of parsed documents."""
    return parsed.select("doc_id", F.inline("page_sizes"))


def chunk_config(path: Column) -> Column:
    """struct<chunk_size, overlap> of a path whose folder or file names them (..._256_50, ...cs256.ov50...); nulls where it doesn't."""
    size = F.coalesce(F.nullif(F.regexp_extract(path, r"cs(\d+)\.ov(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"_(\d+)_(\d+)(?:/|$)", 1), F.lit("")))
    overlap = F.coalesce(F.nullif(F.regexp_extract(path, r"cs(\d+)\.ov(\d+)", 2), F.lit("")), F.nullif(F.regexp_extract(path, r"_(\d+)_(\d+)(?:/|$)", 2), F.lit("")))
    return F.struct(size.cast("int").alias("chunk_size"), overlap.cast("int").alias("overlap"))


def model_folder(name: str, hub: str | None = None) -> str:
    """The folder of a model on the driver: a path that exists, else the last cached snapshot of "owner/name"; raises without either."""
    import os

    given = os.path.expanduser(name)
    if os.path.exists(given):
        return os.path.realpath(given)
    owner, slash, rest = name.strip().partition("/")
    if not slash:
        raise ValueError(f"no model at {name!r}")
    root = os.path.join(os.path.expanduser(hub or "~/.cache/huggingface/hub"), f"models--{owner}--{rest}")
    snapshots = os.path.join(root, "snapshots")
    found = sorted(x for x in (os.listdir(snapshots) if os.path.isdir(snapshots) else []) if os.path.isdir(os.path.join(snapshots, x)))
    if found:
        return os.path.realpath(os.path.join(snapshots, found[-1]))
    raise ValueError(f"no cached snapshot of {name!r}")


def checkpoint_rows(spark: SparkSession, path: str) -> DataFrame:
    """Finished queries of an append-only JSON lines log; malformed lines and rows without qid are skipped."""
    rows = spark.read.schema(f"{CHECKPOINT}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record IS NULL AND qid IS NOT NULL").drop("_corrupt_record")


def remaining(records: DataFrame, done: DataFrame, key: str = "qid") -> DataFrame:
    """What a resumed run has still to do."""
    return records.join(done.select(key), key, "left_anti")


def index_catalog(tables: DataFrame) -> DataFrame:
    """index, complete, preferred of (index, part) rows: complete ones have all mandatory parts; an HNSW index is preferred, else the first."""
    found = tables.groupBy("index").agg(F.collect_set("part").alias("parts"))
    rows = found.select("index", F.forall(F.array(*map(F.lit, PARTS)), lambda p: F.array_contains("parts", p)).alias("complete"))
    w = Window.orderBy(F.desc("complete"), F.desc(F.lower("index").contains("hnsw")), "index")  # a row per index
    return rows.withColumn("preferred", (F.row_number().over(w) == 1) & F.col("complete"))


def index_documents(store: DataFrame) -> DataFrame:
    """The first record of each source, by doc_id."""
    w = Window.partitionBy("source_pdf").orderBy("faiss_id", "docstore_id")
    return store.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__").orderBy("doc_id")


def _pdf(spark: SparkSession, path: str, schema: str, rows_of) -> DataFrame:
    """Rows that ``rows_of`` (name, document) finds in PDF files, where PyMuPDF is installed; files are read in tasks."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import fitz
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    rows += rows_of(name, doc)
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(run, schema)


def pdf_words(spark: SparkSession, path: str) -> DataFrame:
    """doc, page, block, line, x0, top, x1, bottom, word of PDF files."""

    def rows(name, doc):
        return [(name, n + 1, int(w[5]), int(w[6]), *map(float, w[:4]), w[4]) for n, page in enumerate(doc) for w in page.get_text("words")]

    return _pdf(spark, path, "doc string, page int, block int, line int, x0 double, top double, x1 double, bottom double, word string", rows)


def pdf_tables(spark: SparkSession, path: str) -> DataFrame:
    """doc, page, x0, top, x1, bottom, rows of the tables that PDF files show: by their lines, or without any by their layout; a page that can't be read has none."""

    def rows(name, doc):
        out = []
        for n, page in enumerate(doc):
            for strategy in ("lines", "text"):
                try:
                    found = page.find_tables(strategy=strategy).tables
                except Exception:
                    found = []
                if found:
                    out += [(name, n + 1, *map(float, t.bbox), [["" if c is None else str(c) for c in r] for r in t.extract()]) for t in found]
                    break
        return out

    return _pdf(spark, path, "doc string, page int, x0 double, top double, x1 double, bottom double, rows array<array<string>>", rows)


def parsed_by(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Rows that a layout model finds: ``parse`` takes (path, bytes) of a PDF file in a task and gives tuples of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([r for name, content in zip(pdf["path"], pdf["content"]) for r in parse(name, bytes(content))], columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(run, schema)


def lines_of_words(words: DataFrame, gap: float = 18.0) -> DataFrame:
    """doc, page, block, line, part, x0, top, x1, bottom, text: words of a line joined, and parted where ``gap`` lies between two."""
    from pyspark.sql.window import Window

    line = Window.partitionBy("doc", "page", "block", "line").orderBy("x0", "top", "word")
    far = F.col("x0") - F.lag("x1").over(line) > gap
    rows = words.withColumn("part", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(line))
    out = rows.groupBy("doc", "page", "block", "line", "part").agg(
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.array_sort(F.collect_list(F.struct(F.col("x0").alias("at"), "word"))).alias("words")
    )
    return out.withColumn("text", F.array_join(F.transform("words", lambda w: w["word"]), " ")).drop("words")
