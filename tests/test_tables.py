"""Sources and sinks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks.messages import messages, messages_sql
from inkveil.operators.redact import redact
from inkveil.sources.tables import new_folder, read_texts, scratch_root, write_texts

ROWS = [(1, 'a "b", c@d.org\nnext'), (2, ""), (3, None), (4, "plain"), (5, "back\\slash, é")]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(spark, fmt):
    df = spark.createDataFrame(ROWS, "id int, text string")
    source, sink = new_folder(spark), new_folder(spark)
    writer = df.coalesce(1).write.format(fmt)
    (writer.options(header=True, escape='"') if fmt == "csv" else writer).save(source)
    lines = {"multiLine": True} if fmt == "csv" else {}
    read = read_texts(spark, source, fmt, schema="id int, text string", **lines)
    assert sorted(map(tuple, read.collect())) == ROWS
    write_texts(redact(read), sink, fmt)
    back = read_texts(spark, sink, fmt, schema="id int, redacted_text string, changed boolean, n_matches int", **lines)
    assert sorted(map(tuple, back.collect())) == [
        (1, 'a "b", XXX@d.org\nnext', True, 1), (2, "", False, 0), (4, "plain", False, 0),
        (5, "back\\slash, é", False, 0),
    ]


def test_lines_and_whole_files(spark):
    df = spark.createDataFrame([("Dear Ann,\nx",), ("mail a@b.org",)], "redacted_text string")
    path = new_folder(spark)
    write_texts(df.coalesce(1), path, "text")
    lines = read_texts(spark, path, "text")
    assert sorted(r["value"] for r in lines.collect()) == ["Dear Ann,", "mail a@b.org", "x"]
    whole = redact(read_texts(spark, path, "text", wholetext=True), "value")
    assert whole.first()["redacted_text"] == "Dear XXX,\nx\nmail XXX@b.org\n"


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        read_texts(spark, "x", "xml")



def test_scratch_root_is_the_session_setting(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def orders(spark, n):
    return spark.range(n).selectExpr(
        "if(id % 50 = 7, NULL, id) AS o_orderkey", "id % 90 AS o_custkey", "'2-HIGH' AS o_orderpriority",
        "timestamp_ntz'1996-01-02 00:00:00' + make_dt_interval(cast(id % 40 as int)) AS o_orderdate",
    )


def test_messages_of_one_row_group_are_the_work_of_many_tasks(spark, tmp_path):
    """The rows are those of the plain SQL, and the text is built once, after the orders are dealt."""
    path = f"{tmp_path}/orders"
    orders(spark, 2000).coalesce(1).write.parquet(path)
    made = messages(spark, spark.read.parquet(path))
    plain = spark.sql(messages_sql("{orders}"), orders=spark.read.parquet(path))
    assert made.columns == plain.columns
    assert sorted(map(repr, made.collect())) == sorted(map(repr, plain.collect()))
    where = redact(made).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(where) >= 8 and max(r["count"] for r in where) < 1000
    plan = redact(made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Receipt went to") == 1


def test_a_batch_of_one_row_group_is_the_work_of_many_tasks(spark, tmp_path):
    path = f"{tmp_path}/orders"
    orders(spark, 2000).coalesce(1).write.parquet(path)
    stream = messages(spark, spark.readStream.schema(orders(spark, 1).schema).parquet(path))
    parts = stream.withColumn("part", F.spark_partition_id())
    query = parts.writeStream.format("parquet").option("path", f"{tmp_path}/sink").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/sink")
    assert found.count() == 2000 and found.select("part").distinct().count() >= 8
