"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import settled

#: Links that a task holds at once while it thins them out.
FOREST_LINKS = 500_000


def forest(a: Iterable[int], b: Iterable[int]) -> tuple[list[int], list[int]]:
    """For each node of the links (a, b) that is not the least of its component: that least node, and the node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    return [root(x) for x in nodes], nodes


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        u, v = forest(*(np.concatenate(x).tolist() for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size >= FOREST_LINKS:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``: component is the smallest node that it reaches.

    Each task first replaces its links by a spanning forest. Then every node's
    neighbours are tied to the node's smallest neighbour, in turns among the
    larger and the smaller ones, until the table stays as it is; that takes a
    number of rounds that is logarithmic in the length of a chain. A hub's
    links stay separate rows, so that Spark may split them. Null ends and links
    of a node to itself are left out; an empty table gives an empty table.
    """
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = settled(ends.mapInArrow(_thin, "u long, v long").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        edges = settled(small.unionByName(least.select(F.col("m").alias("u"), "v")).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("component")))


def _state(edges: DataFrame) -> tuple[int, int | None]:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
