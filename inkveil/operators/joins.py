"""Joins of a large table with a smaller one of unknown size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.expressions import quoted

BROADCAST_BYTES = 32 << 20
#: Buckets of keys whose rows are counted, and more of them if there are many partitions; how many shares a partition's rows fall into.
BUCKETS, BUCKETS_EACH, SHARES = 4096, 4, 16
ATOMIC = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz", "decimal")


def table_bytes(df: DataFrame) -> int:
    """Size of a table's values, from one distributed pass over it."""
    width = F.octet_length(F.to_json(F.struct(*map(quoted, df.columns))))
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("n")).first()["n"]


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(quoted(key)), F.lit(buckets)).cast("int")


def shares(large: DataFrame, on: str) -> list[int]:
    """Into how many places the rows of each bucket of keys are to be dealt.

    Rows are counted by bucket, in each task before anything is shuffled, so the
    count is a sketch of a fixed size however many keys there are; it is never
    too low for a key. A bucket gets a place for each ``1 / SHARES`` of what a
    partition holds on average, at least one.
    """
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS, BUCKETS_EACH * parts)
    found = large.groupBy(bucket_of(on, buckets).alias("bucket")).count().collect()
    each = max(1, sum(r["count"] for r in found) // (parts * SHARES))
    places = [1] * buckets
    for r in found:
        places[r["bucket"]] = max(1, -(-r["count"] // each))
    return places


def _place(large: DataFrame, places: Column) -> Column:
    """A row's place among those of its key.

    A function of the row's partition and of its narrow columns, texts by their
    length only: a task that runs again sends its rows to the same places,
    which a running number would not promise, and no text is hashed.
    """
    seen = [F.octet_length(quoted(c)) if t in ("string", "binary") else F.col(quoted(c))
            for c, t in large.dtypes if t in ("string", "binary") or t.split("(")[0] in ATOMIC]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *seen), places).cast("int")


def join_lookup(large: DataFrame, lookup: DataFrame, on: str, how: str = "inner",
                limit: int = BROADCAST_BYTES, salts: int | None = None) -> DataFrame:
    """Equi-join with a lookup table on the column ``on`` of both.

    The lookup is broadcast when its measured size is within ``limit``. Beyond
    that both sides are shuffled. The rows of a key go to as many places as
    their number asks for, by one pass over the keys, so that a key that a third of
    the rows share is not the work of one task, and only the lookup's rows of
    such keys are copied. ``salts`` sets the number of places for all keys, for a
    table that would be costly to look at twice.
    """
    if table_bytes(lookup) <= limit:
        return large.join(F.broadcast(lookup), on, how)
    if salts is None:
        places = shares(large, on)
        listed = F.lit(places) if max(places) > 1 else F.lit([1])
        many = F.get(listed, F.pmod(F.xxhash64(quoted(on)), F.lit(len(places) if max(places) > 1 else 1)).cast("int"))
    else:
        many = F.lit(salts)
    salted = large.withColumn("__salt", _place(large, many))
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), many - 1)))
    # The size estimate of a plan may be wrong: rule the broadcast out.
    return salted.join(copies.hint("merge"), [on, "__salt"], how).drop("__salt")
