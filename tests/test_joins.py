"""The join with a lookup table beyond the broadcast limit: same rows, even tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkveil.operators.joins import join_lookup, shares


@pytest.fixture
def even(spark):
    """Forty partitions that stay as they are."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("hot", ["'hot'", "cast(NULL as string)"], ids=["key", "null"])
def test_a_hot_key_is_spread(spark, even, hot):
    """A key, or null, on a third of the rows, whose other columns repeat: no task has twice the rows of the median one."""
    rows = spark.range(0, 120_000, 1, 24).selectExpr(f"if(id % 3 = 0, {hot}, concat('k', id % 5000)) AS key", "id", "repeat('x', cast(id % 50 as int)) AS text")
    lookup = rows.select("key").distinct().where("key IS NOT NULL").withColumn("value", F.concat("key", F.lit("!")))
    done = join_lookup(rows, lookup, "key", "left", 0)
    tasks = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 120_000 and max(tasks) <= 2 * sorted(tasks)[len(tasks) // 2]
    assert done.where("NOT (value <=> concat(key, '!'))").isEmpty()
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()


def test_same_rows_on_every_way(spark):
    """Equal rows, null keys, missing keys and keys of several lookup rows."""
    rows = spark.createDataFrame([(k % 7 if k % 5 else None, "same") for k in range(200)], "key int, text string").repartition(5)
    lookup = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (None, "n"), (9, "z")], "key int, value string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(lookup, "key", how).collect()), key=repr)
        for limit, salts in ((1 << 20, None), (0, None), (0, 3)):
            assert sorted(map(tuple, join_lookup(rows, lookup, "key", how, limit, salts).collect()), key=repr) == want


def test_only_hot_buckets_are_copied(spark):
    rows = spark.range(10_000).selectExpr("if(id < 5000, 0, id) AS key")
    places = shares(rows, "key")
    assert sum(x > 2 for x in places) <= 2 and max(places) > 8
    assert shares(rows.filter("false"), "key") == [1] * len(places)
