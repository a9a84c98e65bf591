"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints at d or fewer bits, cut into d // 2 + 1 segments, differ by one
bit at most in some segment. Each segment is indexed whole, and once for each of
its bits with that bit as a wildcard; fingerprints that meet under a variant are
verified. A variant under which too many meet is cut anew in the bits that are
left, so no bucket is compared whole unless its size has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import col, quoted, settled, table
from inkveil.llm.components import components, forest

SEED = 42
ALL_BITS = (1 << 64) - 1
#: Fingerprints compared with each other in one bucket, and the bits left at which a bucket is small by itself.
BUCKET, LEAST_BITS = 64, 8
#: Texts that a task holds as strings at once.
TOGETHER = 256
LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, width: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    n = max(1, len(words) - width + 1)
    ends = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)), np.uint64, n)
    # eight counters to a word, emptied before one can overflow
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    counts = np.zeros((8, 8), np.int64)
    for shift in range(8):
        lanes = np.add.reduce(((padded >> np.uint64(shift)) & LANES).reshape(-1, 255), axis=1)
        counts[:, shift] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts.ravel() > n, bitorder="little").view(np.uint64)[0])


def simhash(width: int) -> Callable[[Column], Column]:
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(low, TOGETHER).to_pylist() for low in range(0, len(texts), TOGETHER))
        return pa.array(np.array([fingerprint(x, width) for part in parts for x in part], np.uint64).view(np.int64))

    return of


def with_fingerprint(df: DataFrame, text_col: str, out_col: str, width: int = 3) -> DataFrame:
    """``df`` with the SimHash of each text as a long; null and wordless texts have 0."""

    return df.withColumn(out_col, simhash(width)(col(text_col)))


def segments(rest: int, distance: int) -> list[list[int]]:
    """The set bits of ``rest`` in even runs, so many that one run differs by one bit at most."""
    bits = [b for b in range(64) if rest >> b & 1]
    return [x.tolist() for x in np.array_split(np.array(bits), distance // 2 + 1)]


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ np.uint64(by & ALL_BITS)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _variants(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, rest, prints = (batch.column(k).to_numpy().view(np.uint64) for k in range(3))
            for mask in np.unique(rest).tolist():
                own = rest == np.uint64(mask)
                at, fp = path[own], prints[own]
                for number, bits in enumerate(segments(mask, distance)):
                    whole = sum(1 << b for b in bits)
                    left = pa.array(np.full(len(fp), mask & ~whole & ALL_BITS, np.uint64).view(np.int64))
                    for wild in (None, *bits):
                        kept = whole & ~(1 << wild) if wild is not None else whole
                        key = _mixed(_mixed(at, number * 65 + (64 if wild is None else wild)) ^ (fp & np.uint64(kept)), mask)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), left, pa.array(fp.view(np.int64))], ["key", "rest", "print"])

    return cut


def _meet(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def links(fp: np.ndarray, key: np.ndarray) -> tuple[list[int], list[int]]:
        """A spanning forest of what lies close among the rows of each key."""
        at, a, b = np.arange(len(fp)), [], []
        for step in range(1, len(fp)):
            at = at[at + step < len(fp)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            apart = np.bitwise_count(fp[at] ^ fp[at + step])
            close = at[(apart <= distance) & (apart > 0)]
            if len(close):
                x, y = forest([*a, *fp[close].view(np.int64).tolist()], [*b, *fp[close + step].view(np.int64).tolist()])
                a, b = list(x), list(y)
        return a, b

    def out(a: list[int], b: list[int], deeper: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
        more = (np.zeros(0, np.int64),) * 3 if deeper is None else deeper
        n = len(a)
        return pa.RecordBatch.from_arrays([
            pa.array(np.r_[np.ones(n, bool), np.zeros(len(more[0]), bool)]),
            pa.array(np.r_[np.array(a, np.int64), more[0]]), pa.array(np.r_[np.array(b, np.int64), more[1]]), pa.array(np.r_[np.zeros(n, np.int64), more[2]])], ["link", "a", "b", "print"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by rising key. Small buckets give links; the rows of a large one go on as (key, rest, print)."""
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        large = None

        def work(key: np.ndarray, rest: np.ndarray, fp: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, large
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            final = np.bitwise_count(rest[starts].view(np.uint64)) <= LEAST_BITS
            big = (sizes > BUCKET) & ~final
            if large is not None and len(key) and key[0] == large:
                big[0] = True  # its first rows have gone on already
            large = key[-1] if len(key) and big[-1] else None
            rows = np.repeat(big, sizes)
            stay = np.repeat(~big, sizes)
            if not last and len(key) and not big[-1]:
                held = [x[starts[-1] :] for x in (key, rest, fp)]
                stay[starts[-1] :] = False
            else:
                held = [np.zeros(0, np.int64)] * 3
            a, b = links(fp[stay].view(np.uint64), key[stay])
            if a or rows.any():
                yield out(a, b, (key[rows], rest[rows], fp[rows]))

        for batch in batches:
            yield from work(*(np.r_[x, batch.column(k).to_numpy()] for k, x in enumerate(held)), last=False)
        if len(held[0]):
            yield from work(*held, last=True)

    return meet


def close_prints(prints: DataFrame, distance: int) -> DataFrame:
    """Links ``(a, b)`` that join all of the distinct fingerprints ``prints(print)`` at ``distance`` or fewer bits: a forest, not every pair."""
    state = prints.select(F.lit(0).cast("long").alias("path"), F.lit(-1).cast("long").alias("rest"), "print")
    links = None
    while True:
        dealt = state.mapInArrow(_variants(distance), "key long, rest long, print long").repartition("key").sortWithinPartitions("key")
        met = settled(dealt.mapInArrow(_meet(distance), "link boolean, a long, b long, print long"))
        found = met.where("link").select("a", "b")
        links = found if links is None else links.unionByName(found)
        state = met.where("NOT link").select(F.col("a").alias("path"), F.col("b").alias("rest"), "print")
        if state.isEmpty():
            return links


def _rooted(rows: DataFrame, distance: int) -> DataFrame:
    """``(print, rep, root)`` for each fingerprint of ``rows(id, print)``: its least id, and the least fingerprint that links reach."""
    reps = rows.groupBy("print").agg(F.min("id").alias("rep"))
    tied = components(close_prints(reps.select("print"), distance)).withColumnRenamed("node", "print")
    return settled(reps.join(tied, "print", "left").select("print", "rep", F.coalesce("component", "print").alias("root")))


def groups(rows: DataFrame, distance: int) -> DataFrame:
    """``(print, root, component_id)`` for each fingerprint of ``rows(id, print)``: the least fingerprint and the least id that links reach."""
    reps = _rooted(rows, distance)
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    return reps.join(least, "root").select("print", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, width: int = 3, distance: int = 2) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row, under the name of ``id_col``; the fingerprint is a long.

    Fingerprints at ``distance`` or fewer bits are linked; ``component_id`` is
    the least id that links reach. Null and wordless texts have fingerprint 0,
    and are linked like any other. Rows with a null id take part but lend no id:
    a component of such rows only has a null one. Equal rows and repeated ids are
    kept, each row with its own fingerprint. An empty table gives an empty table.
    """
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    rows = settled(with_fingerprint(rows, "text", "print", width).select("id", "print"))
    named = groups(rows, distance).drop("root")
    return rows.join(named, "print").select(F.col("id").alias(id_col), F.col("print").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str, text_col: str, width: int = 3, distance: int = 2) -> DataFrame:
    """One row of ``docs`` of each group that ``near_duplicates`` finds: one with the group's least id, in the same columns.

    Rows whose id is theirs alone are taken by it, and texts move once, to meet
    the ids that stay. Where an id repeats, or a group has null ids only, its row
    is found by the fingerprint as well, the least one of the rows with that id.
    An empty table gives an empty table.
    """
    field = lambda name: F.col(f"row.{quoted(name)}")
    rows = docs.select(F.struct(*map(col, docs.columns)).alias("row")).select("row", field(id_col).cast("long").alias("id"))
    prints = settled(docs.select(col(id_col).cast("long").alias("id"), simhash(width)(col(text_col)).alias("print")))
    first = F.coalesce(F.min_by("print", F.when(F.col("rep").isNotNull(), F.struct("rep", "print"))), F.min("print"))
    stay = _rooted(prints, distance).groupBy("root").agg(F.min("rep").alias("id"), first.alias("print"))
    repeated = prints.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND id IS NOT NULL").select("id")
    single = rows.join(stay.join(repeated, "id", "left_anti").where("id IS NOT NULL").select("id"), "id").select("row.*")
    again = settled(stay.where("id IS NULL").unionByName(stay.join(repeated, "id", "left_semi").select(*stay.columns)))
    if again.isEmpty():
        return single
    mine = rows.withColumn("print", simhash(width)(field(text_col))).join(again.withColumnRenamed("id", "least"), "print").where(F.col("id").eqNullSafe(F.col("least")))
    return single.unionByName(mine.groupBy("root").agg(F.first("row").alias("row")).select("row.*"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents: 3-word shingles, 2 bits."""
    done = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", 3, 2)
    return done.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))
