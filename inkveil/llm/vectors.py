"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine c or more lie within the squared distance 2 - 2c.
Rotated and split into blocks of a few dimensions, two such vectors must be
within their share of that distance in one block at least. Each block is
range-joined on its own over a grid on its first coordinates; what passes in
any block is verified by the cosine of the vectors as given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import col, settled, table
from inkveil.llm.components import components, forest

#: Dimensions of a block, rows of a chunk of a cell, and pairs verified at a time.
BLOCK_DIMS, CHUNK, PAIRS = 8, 2048, 1 << 15
#: Room for rounding when a block's distance is compared with its share.
SLACK = 1e-9


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    return np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]


def unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small values stay in range
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(_summed(scaled * scaled))[:, None]


def _summed(x: np.ndarray) -> np.ndarray:
    """Row sums in one fixed order, so that every task gets the same bits."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k]
    return total


def rotated(units: np.ndarray) -> np.ndarray:
    turn = rotation(units.shape[1])
    total = np.zeros_like(units)
    for k in range(units.shape[1]):
        total += units[:, k : k + 1] * turn[k]
    return total


def blocks_of(dims: int) -> list[slice]:
    edges = np.linspace(0, dims, max(1, dims // BLOCK_DIMS) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def shares(dims: int, threshold: float) -> list[float]:
    """Each block's share of the squared distance, in proportion to its dimensions."""
    return [(2 - 2 * threshold) * (b.stop - b.start) / dims + SLACK for b in blocks_of(dims)]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in chunks])
    return flat.reshape(len(column), -1).astype(np.float64)


def _dealer(threshold: float, grid: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per vector, block and cell: its own cell, and the neighbour cells that come after it."""
    steps = list(product((-1, 0, 1), repeat=grid))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dims))
                turned = rotated(unit(_matrix(part.column("vector"))))
                for k, (block, share) in enumerate(zip(blocks_of(dims), shares(dims, threshold), strict=True)):
                    axes = min(grid, block.stop - block.start)
                    cells = np.floor(turned[:, block][:, :axes] / np.sqrt(share)).astype(np.int64)
                    for step in {s[:axes] for s in steps}:
                        if step < (0,) * axes:
                            continue
                        at = cells + np.array(step)
                        place = np.zeros(len(at), np.int64)
                        for axis in range(axes):
                            place = place * 4_000_003 + at[:, axis]
                        yield pa.RecordBatch.from_arrays(
                            [part.column("label"), pa.array(np.full(len(at), dims, np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(place),
                             pa.array(np.full(len(at), any(step))), part.column("rep"), part.column("copies"), part.column("vector")],
                            ["label", "dims", "block", "cell", "visits", "rep", "copies", "vector"])

    return deal


def _joiner(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def links(part: pa.Table) -> pa.Table:
        """Per vector: the copies that it is linked to here, and the least vector that its links reach here."""
        part = part.combine_chunks()
        k, (low, high) = part["block"][0].as_py(), (part[x][0].as_py() for x in ("low", "high"))
        rep, copies, chunk, visits = (part[x].to_numpy() for x in ("rep", "copies", "chunk", "visits"))
        units = unit(_matrix(part["vector"]))
        turned, blocks, share = rotated(units), blocks_of(units.shape[1]), shares(units.shape[1], threshold)
        found, a_all, b_all = np.zeros(len(rep), np.int64), [], []
        first, second = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        mine = np.ascontiguousarray(turned[:, blocks[k]])
        square = (mine * mine).sum(axis=1)
        for top in range(0, len(first), 512):
            rows = first[top : top + 512]
            near = square[rows][:, None] + square[second] - 2 * (mine[rows] @ mine[second].T) <= share[k] + SLACK
            i, j = np.nonzero(near)
            i, j = rows[i], second[j]
            # a pair comes once: from one chunk in one order, and not from two neighbours' vectors
            fair = ~(visits[i] & visits[j]) if low != high else (i < j) & ~(visits[i] & visits[j])
            i, j = i[fair], j[fair]
            for at in range(0, len(i), PAIRS):
                x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                # the first block that lets a pair pass is the one that counts it
                fits = np.ones(len(x), bool)
                for e in range(k + 1):
                    gap = turned[x, blocks[e]] - turned[y, blocks[e]]
                    inside = _summed(gap * gap) <= share[e]
                    fits &= inside if e == k else ~inside
                x, y = x[fits], y[fits]
                linked = _summed(units[x] * units[y]) >= threshold
                x, y = x[linked], y[linked]
                np.add.at(found, x, copies[y])
                np.add.at(found, y, copies[x])
                a, b = forest(rep[x].tolist(), rep[y].tolist())
                a_all += a
                b_all += b
        roots, nodes = forest(a_all, b_all)
        tied = dict(zip(nodes, roots, strict=True))
        has = np.flatnonzero(found)
        return pa.table({"rep": rep[has], "links": found[has], "least": pa.array([tied.get(x, x) for x in rep[has].tolist()], pa.int64())})

    return links


def near_duplicates(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float = 0.98, chunk: int = CHUNK, grid: int | None = None) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row, under the name of ``id_col``.

    Two vectors are linked if their labels are equal and not null and their
    cosine in double precision is ``threshold`` (0.5 to 1) or more. Vectors that
    are null, empty, zero or hold null or non-finite components, rows without a
    label, and vectors of unequal length are linked with nothing. ``n_links``
    counts the other rows linked directly; ``component_id`` is the least id
    reachable. A repeated row counts as a copy of itself, so that it has a link;
    a null id stays null, with no component. An empty table gives an empty table.

    Exact copies are gathered first. A cell of the grid that holds over
    ``chunk`` rows is cut into chunks, and each pair of chunks is a task of its
    own; tasks return counts and spanning forests, never pairs. ``grid`` is the
    number of coordinates of a block that make a cell; left out, it follows from
    the number of vectors and changes no result.
    """
    rows = vectors.select(col(id_col).cast("long").alias("id"), col(label_col).alias("label"), col(vector_col).alias("vector"))
    usable = F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(F.col("id").isNotNull() & usable, F.lit(False)))
    sound = rows.where("sound").drop("sound")
    reps = settled(sound.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    if grid is None:
        grid = 1 + (reps.count() > 1 << 20) + (reps.count() > 1 << 26)
    kinds = {f.name: f.dataType.simpleString() for f in reps.schema}
    dealt = reps.mapInArrow(_dealer(threshold, grid), f"label {kinds['label']}, dims int, block int, cell long, visits boolean, rep long, copies long, vector {kinds['vector']}")
    cell = ["label", "dims", "block", "cell"]
    # a cell into which no vector falls by itself has nothing to compare
    sizes = dealt.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("visits")).alias("own")).where("own > 0 AND n > 1")
    sizes = sizes.select(*cell, F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("chunks"))
    parts = dealt.join(sizes, cell).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("chunks")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    parts = parts.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")}).drop("other", "chunks")
    found = settled(parts.groupBy(*cell, "low", "high").applyInArrow(_joiner(threshold), "rep long, links long, least long"))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "rep")
    done = reps.join(linked, "rep", "left").join(tied, "rep", "left").select(
        F.col("label"), F.col("vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = sound.join(done, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.98)


OP9_SQL = """
WITH RECURSIVE unit AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), sound AS (
    SELECT * FROM unit WHERE v IS NOT NULL AND label IS NOT NULL
      AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM unit UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
    SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT l.a AS vec_id, coalesce(d.n_links, 0) AS n_links, l.component_id, l.a = l.component_id AS kept
FROM least l LEFT JOIN degree d ON l.a = d.a
"""
