"""Table functions from SQL against the DataFrame operators."""

from quillspark.functions import table_functions
from quillspark.operators import chunking


def test_packing_from_sql(spark):
    table_functions.register(spark)
    rows = [(d, s, "", k, 1 + k // 3, f"b{k}", f"word{k} " * (k * 7 % 23) + "。" if k % 5 else None) for d in (1, 2) for s in ("x", "y") for k in range(12)]
    units = spark.createDataFrame(rows, "doc_id long, section string, subsection string, ord int, page int, block_id string, text string")
    units.createOrReplaceTempView("units")
    got = spark.sql("SELECT * FROM pack_units(TABLE(units) PARTITION BY (doc_id, section, subsection) ORDER BY (ord), 20, 6)").collect()
    want = chunking.chunk_sections(units, 20, 6).collect()
    shown = lambda found: sorted((str(r.doc_id), r.section, r.chunk_no, r.text, tuple(r.block_ids), r.page_start, r.page_end, r.tokens) for r in found)
    assert shown(got) == shown(want) and len(got) > 8
    assert spark.sql("SELECT * FROM pack_units(TABLE(SELECT * FROM units WHERE false) PARTITION BY doc_id ORDER BY (ord))").count() == 0
    pieces = spark.sql("SELECT u.ord, p.* FROM units u, LATERAL split_pieces(u.text, 5) p WHERE u.doc_id = 1 AND u.section = 'x'").collect()
    assert {(r.ord, r.piece_no): r.piece for r in pieces} == {(r[3], n): p for r in rows if r[0] == 1 and r[1] == "x" and r[6] for n, p in enumerate(chunking.split_long(r[6], 5))}
