"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse: an array of terms and an array of integer weights. A task gets
one block of candidates and one group of queries. It turns the block into
postings, lets each query's terms scatter their weighted postings into a dense
array of scores, selects the best by partition, and only these go on to be
merged. No score is bounded or skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.common import settled, table

#: Candidates in a block, queries in a group, and queries scored at a time (their scores stay in the cache).
BLOCK, GROUP, TOGETHER = 8192, 1024, 16


class Rows:
    """Sparse rows as flat arrays, by rising id; a row's repeated terms add up. ``rows`` tells rows of one id apart."""

    def __init__(self, part: pa.Table) -> None:
        part = part.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
        self.ids, self.rows = part["id"].to_numpy(), part["row"].to_numpy()
        terms, weights = (_flat(part[name]) for name in ("terms", "weights"))
        row = np.repeat(np.arange(len(self.ids)), _lengths(part["terms"]))
        order = np.lexsort((row, terms))
        terms, row, weights = terms[order], row[order], weights[order]
        if len(terms):
            first = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])])
            terms, row, weights = terms[first], row[first], np.add.reduceat(weights, first)
        self.terms, starts = np.unique(terms, return_index=True)
        ends = np.r_[starts[1:], len(terms)].astype(int)
        self.postings = {t: (row[s:e], weights[s:e]) for t, s, e in zip(self.terms.tolist(), starts.tolist(), ends.tolist(), strict=True)}

    def heaviest(self) -> int:
        """At least the sum of any row's absolute weights."""
        total = np.zeros(len(self.ids) + 1)
        for row, weights in self.postings.values():
            total[row] += np.abs(weights.astype(float))
        return int(total.max())


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return pa.concat_arrays([x.flatten() for x in column.chunks] or [pa.array([], column.type.value_type)]).to_numpy(zero_copy_only=False).astype(np.int64)


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return pc.list_value_length(column).to_numpy()


def best(queries: Rows, block: Rows, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each query, by id and row, its k best candidates of the block (fewer if there are no more): ids and scores."""
    n = len(block.ids)
    most = max(1, queries.heaviest()) * max([1, *(int(np.abs(w).max()) for _, w in block.postings.values())])
    if most >= 2**63:
        raise OverflowError("scores beyond 63 bits")
    kind = np.int32 if most < 2**31 else np.int64
    place = {row: at for at, row in enumerate(block.rows.tolist())}
    postings = {}
    for term, (row, weights) in block.postings.items():
        if 2 * len(row) > n:  # a long list is kept with its gaps
            dense = np.zeros(n, kind)
            dense[row] = weights
            postings[term] = None, dense
        else:
            postings[term] = row, weights.astype(kind)
    weights = {t: queries.postings[t] for t in queries.postings if t in postings}
    scores, product = (np.empty((TOGETHER, n), kind) for _ in range(2))
    for low in range(0, len(queries.ids), TOGETHER):
        high = min(low + TOGETHER, len(queries.ids))
        scores[:] = 0
        for term, (asking, weight) in weights.items():
            a, b = np.searchsorted(asking, (low, high))
            if a == b:
                continue
            at, by = asking[a:b] - low, weight[a:b].astype(kind)
            row, given = postings[term]
            if row is not None:
                scores[np.ix_(at, row)] += np.multiply.outer(by, given)
            elif b - a == TOGETHER:
                np.multiply(by[:, None], given, out=product)
                np.add(scores, product, out=scores)
            else:
                scores[at] += np.multiply.outer(by, given)
        for i in range(low, high):
            mine, own = scores[i - low], place.get(int(queries.rows[i]))
            kept = np.arange(n)
            if own is not None:
                kept = np.delete(kept, own)
                mine = mine[kept]
            if len(mine) > k:
                least = np.partition(mine, len(mine) - k)[len(mine) - k]
                at = np.flatnonzero(mine >= least)
                kept, mine = kept[at], mine[at]
            order = np.lexsort((kept, -mine.astype(np.int64)))[:k]
            yield queries.ids[i], queries.rows[i], block.ids[kept[order]], mine[order].astype(np.int64)


def _scorer(k: int) -> Callable[[pa.Table], pa.Table]:
    def score(part: pa.Table) -> pa.Table:
        asks = part["asks"].to_numpy()
        queries, block = (Rows(part.filter(pa.array(asks == flag)).select(["id", "row", "terms", "weights"])) for flag in (True, False))
        found = list(best(queries, block, k)) if len(queries.ids) and len(block.ids) else []
        times = [len(x[2]) for x in found]
        return pa.table({
            "query_id": pa.array(np.repeat([x[0] for x in found], times).astype(np.int64)),
            "query_row": pa.array(np.repeat([x[1] for x in found], times).astype(np.int64)),
            "vec_id": pa.array(np.concatenate([x[2] for x in found]) if found else [], pa.int64()),
            "score": pa.array(np.concatenate([x[3] for x in found]) if found else [], pa.int64()),
        })

    return score


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest integer inner products, ties to the smaller id.

    Both tables hold ``id long``, ``row long``, ``terms array<int>`` and
    ``weights array<long>``, none null; other columns are left out. ``row`` is
    a row's own number in both tables: rows of one id are candidates, and
    queries, each for itself, and only the row itself is left out. A candidate that
    shares no term with a query has score 0 and counts like any other. Fewer than k
    candidates give fewer rows, an empty table none. Blocks and groups are dealt
    by a hash of the row, so their size does not depend on the data; a candidate
    is sent once to each group of queries.
    """
    blocks = max(1, -(-candidates.count() // BLOCK))
    groups = max(1, -(-queries.count() // GROUP))
    columns = ["id", "row", "terms", "weights"]
    part = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    given = candidates.select(*columns, F.lit(False).alias("asks"), part(blocks, 1).alias("block"), every(groups).alias("group"))
    asked = queries.select(*columns, F.lit(True).alias("asks"), part(groups, 2).alias("group"), every(blocks).alias("block"))
    found = given.unionByName(asked).groupBy("block", "group").applyInArrow(_scorer(k), "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, key: Column, vector: Column, factor: int) -> DataFrame:
    """Sparse rows ``(id, row, terms, weights)`` of ``floor(factor * x)`` over each vector's components, kept with their row numbers.

    Vectors that are null or hold null or non-finite components, and rows
    without an id, are left out; rows of one id all stay. Other columns of
    ``vectors`` are left out, whatever their names.
    """
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(key.cast("long").alias("id"), vector.cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL").where(sound)
    weights = F.transform("vector", lambda x: F.floor(F.lit(float(factor)) * x))
    rows = rows.select("id", F.filter(F.transform(weights, lambda w, i: F.struct(i.alias("t"), w.alias("w"))), lambda x: x["w"] != 0).alias("x"))
    return settled(rows.select("id", F.monotonically_increasing_id().alias("row"), F.col("x.t").alias("terms"), F.col("x.w").alias("weights")))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every embedding whose id is divisible by 20."""
    rows = quantised(table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"), 64)
    return top_k(rows, rows.where("id % 20 = 0"), 20)


OP8_SQL = """
WITH part AS (
    SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.rn, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM part q JOIN part c ON q.rn <> c.rn WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
