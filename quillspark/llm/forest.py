"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors by random directions at the median, and vectors close to
a split go to both sides (spill). The upper levels of the trees are fitted on a bounded
sample, every row is routed through them, and nodes that are still large are split
again the same way; within a task the splits go on down to leaves of some hundred rows.
All pairs of a leaf are compared in double precision; a leaf writes each row's link to
the smallest of its component there, never its pairs. Links of all trees are united by
connected components. Links per row are then counted inside components, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.components import connected_components
from quillspark.session import materialize

TREES = 8
#: Rows that a tree's node may hold when it goes to a task, and that a leaf may.
GROUP, LEAF = 8192, 256
#: Rows, by hash, on which the upper levels are fitted, in each round.
SAMPLE = 20_000
#: Half-width of the band around a split that goes to both sides, and the most of its rows that it may take.
SPILL, SPILL_SHARE = 0.02, 0.12
#: Rows of one side of a block in which links are counted, and of a strip of it that is held at once.
BLOCK, STRIP = 4096, 512
MAX_ROUNDS = 8


def _direction(tree: int, node: int, dims: int) -> np.ndarray:
    v = np.random.default_rng([tree, node & 0xFFFFFFFF, node >> 32]).standard_normal(dims)
    return v / np.linalg.norm(v)


def _cut(p: np.ndarray) -> tuple[float, float]:
    """(where to split projections, half-width of the spill)."""
    low, mid, high = np.quantile(p, [0.5 - SPILL_SHARE / 2, 0.5, 0.5 + SPILL_SHARE / 2])
    return float(mid), float(min(SPILL, (high - low) / 2))


def _unit(vectors: list, dims: int) -> np.ndarray:
    x = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        x[k, : len(v)] = v
    return _scaled(x)


def _flat_unit(vectors: pa.Array, dims: int) -> np.ndarray:
    """The same of an Arrow array of lists, without Python objects."""
    size = np.asarray(vectors.value_lengths(), np.int64)
    x = np.zeros((len(vectors), dims))
    x[np.arange(dims) < size[:, None]] = np.asarray(vectors.flatten())
    return _scaled(x)


def _scaled(x: np.ndarray) -> np.ndarray:
    # scaled first, so that no square overflows or vanishes
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(x: np.ndarray, tree: int, node: int, levels: int, cuts: dict[tuple[int, int], tuple[float, float]]) -> None:
    if levels == 0 or len(x) < 16:
        return
    p = x @ _direction(tree, node, x.shape[1])
    mid, width = cuts[tree, node] = _cut(p)
    _fit(x[p <= mid + width], tree, 2 * node, levels - 1, cuts)
    _fit(x[p >= mid - width], tree, 2 * node + 1, levels - 1, cuts)


def _route(cuts, dims: int):
    """Rows (tree, node, id, vector) go down as far as there are cuts; spilled rows come out more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = cuts.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _flat_unit(batch.column(3), dims)
            tree, node = (np.asarray(batch.column(k)) for k in (0, 1))
            todo = [(int(t), int(n), np.flatnonzero((tree == t) & (node == n))) for t, n in sorted(set(zip(tree.tolist(), node.tolist())))]
            rows, nodes = [], []
            while todo:
                t, n, at = todo.pop()
                if (t, n) not in table:
                    rows.append(at)
                    nodes.append(np.full(len(at), n, np.int64))
                    continue
                mid, width = table[t, n]
                p = x[at] @ _direction(t, n, dims)
                todo += [(t, 2 * n, at[p <= mid + width]), (t, 2 * n + 1, at[p >= mid - width])]
            at = np.concatenate(rows)
            out = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array(np.concatenate(nodes)), out.column(2), out.column(3)], names=["tree", "node", "id", "v"])

    return run


def _leaf_links(dims: int, least: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(key[0]), int(key[1])
        ids = pdf["id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _unit(pdf["v"].tolist(), dims)[order]
        found: set[tuple[int, int]] = set()
        todo = [(node, np.arange(len(ids)))]
        while todo:
            n, at = todo.pop()
            if len(at) > LEAF:
                p = x[at] @ _direction(tree, n, dims)
                mid, width = _cut(p)
                left, right = at[p <= mid + width], at[p >= mid - width]
                if max(len(left), len(right)) < 0.9 * len(at):
                    todo += [(2 * n, left), (2 * n + 1, right)]
                    continue
            # a leaf, or rows that no projection tells apart: compared in blocks with the components so far
            label = np.arange(len(at))
            near = [np.flatnonzero(x[at] @ x[i] >= least) for i in at] if len(at) > 4 * LEAF else [np.flatnonzero(r) for r in x[at] @ x[at].T >= least]
            changed = True
            while changed:
                new = np.array([label[r].min() if len(r) else k for k, r in enumerate(near)])
                new = new[new]
                changed = bool((new != label).any())
                label = new
            for k in np.flatnonzero(label != np.arange(len(at))):
                found.add((int(ids[at[k]]), int(ids[at[label[k]]])))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def forest_links(vectors: DataFrame, dims: int, least: float, trees: int = TREES, group: int = GROUP) -> DataFrame:
    """Links (a, b) that connect what the leaves of the forest find; vectors: id, v (usable, distinct)."""
    spark = vectors.sparkSession
    placed = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"), "id", "v")
    done = None
    rows = vectors.count()
    largest = rows
    for round_no in range(MAX_ROUNDS):
        if largest <= group:
            break
        levels = int(np.ceil(np.log2(largest / group))) + 1
        # about SAMPLE rows, the same in any run; at first every tree is fitted on all of them
        chosen = F.pmod(F.xxhash64("id", F.lit(round_no)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / rows) * (1 << 30))
        source = placed if round_no else vectors.select(F.lit(0).alias("tree"), F.lit(1).cast("long").alias("node"), "id", "v")
        sample = source.where(chosen).toArrow()
        tree, node = (np.asarray(sample.column(k)) for k in (0, 1))
        order = np.argsort(np.asarray(sample.column(2)), kind="stable")
        x = _flat_unit(sample.column(3).combine_chunks(), dims)
        cuts: dict[tuple[int, int], tuple[float, float]] = {}
        for t, n in sorted(set(zip(tree.tolist(), node.tolist()))):
            part = x[order[((tree == t) & (node == n))[order]]]
            for k in range(trees) if not round_no else [t]:
                _fit(part, k, n, levels, cuts)
        if not cuts:
            break
        schema = f"tree int, node long, id long, v {dict(vectors.dtypes)['v']}"
        placed = materialize(placed.mapInArrow(_route(spark.sparkContext.broadcast(cuts), dims), schema), "routed")
        sizes = materialize(placed.groupBy("tree", "node").agg(F.count("*").alias("size")), "nodes")
        large = sizes.where(F.col("size") > group)
        small = placed.join(large, ["tree", "node"], "left_anti")
        done = small if done is None else done.unionByName(small)
        placed = placed.join(large.drop("size"), ["tree", "node"], "left_semi")
        rows, largest = large.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
        if not rows:
            placed = None
            break
    parts = placed if done is None else done if placed is None else done.unionByName(placed)
    return parts.groupBy("tree", "node").applyInPandas(_leaf_links(dims, least), "a long, b long").distinct()


def _count_links(dims: int, least: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        x, copies, ids = _unit(pdf["v"].tolist(), dims), pdf["copies"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n = np.zeros(len(pdf), np.int64)
        own = not len(right)
        if own:
            right = left
        for k in range(0, len(left), STRIP):
            rows = left[k : k + STRIP]
            near = x[rows] @ x[right].T >= least
            if own:
                near[np.arange(len(rows)), np.arange(k, k + len(rows))] = False
            else:
                n[right] += copies[rows] @ near
            n[rows] += near @ copies[right]
        return pd.DataFrame({"id": ids, "n": n})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95, trees: int = TREES, group: int = GROUP) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, any others).

    Rows link at a cosine of ``least`` or more, in double precision; the forest finds
    the components, and every linked pair inside a component counts. Vectors that are
    null, zero, empty or hold null or non-finite components link with nothing; shorter
    vectors count as filled with zeros. Equal vectors are compared once. Of rows that
    repeat a vec_id the smallest vector counts for all; rows of null vec_id link with
    nothing, have a null component_id and are kept.
    """
    # floats stay as narrow as they are; anything else is compared as it is in double precision
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("v"))
    usable = (
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    keyed = rows.where(F.coalesce(usable, F.lit(False))).groupBy("id").agg(F.min("v").alias("v"))
    keyed = materialize(keyed.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")), "vectors")
    classes = materialize(keyed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"), F.count("*").alias("copies")), "classes")
    dims = classes.agg(F.max(F.size("v"))).first()[0] or 1
    links = materialize(forest_links(classes.select("id", "v"), dims, least, trees, group), "links")
    components = connected_components(links, "a", "b")
    # links inside components: blocks of a component against themselves and each other
    members = components.select(F.col("node").alias("id"), "component").unionByName(components.select(F.col("component").alias("id"), "component").distinct())
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    cells = members.join(sizes, "component").join(classes.select("id", "v", "copies"), "id")
    cells = cells.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    cells = cells.withColumn("side", F.when((F.col("lo") != F.col("hi")) & (F.col("part") == F.col("hi")), 1).otherwise(0))
    # small components go to a task together; their blocks stay apart by the component
    counted = cells.select("component", "lo", "hi", "side", "id", "v", "copies").groupBy("component", "lo", "hi").applyInPandas(_count_links(dims, least), "id long, n long")
    counted = counted.groupBy("id").agg(F.sum("n").alias("n"))
    of_class = classes.select("h1", "h2", F.col("id").alias("rep"), "copies").join(counted.withColumnRenamed("id", "rep"), "rep", "left")
    of_class = of_class.join(members.withColumnRenamed("id", "rep"), "rep", "left").select(
        "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    found = keyed.select("id", "h1", "h2").join(of_class, ["h1", "h2"]).drop("h1", "h2")
    out = rows.select("id").join(found, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
