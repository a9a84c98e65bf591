"""Reading and writing tables of texts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", schema=None,
               **options) -> DataFrame:
    """A table of texts. ``text`` gives one row per line in the column
    ``value`` (one per file with ``wholetext=True``); CSV and JSON want a schema.
    CSV whose texts hold line ends needs ``multiLine=True``; a file is then one task."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        # Texts may hold quotes, and "" is not NULL.
        reader = reader.options(header=True, escape='"', nullValue="\0")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_texts(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result. Formats without nested types get the flat columns only."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    if fmt == "text":
        df = df.select("redacted_text")
    elif fmt == "csv":
        df = df.drop("entity_counts", "matches")
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.options(header=True, escape='"')
    writer.save(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows, dealt to as many tasks as the session shuffles into, by the hash of ``by``.

    A row group of a file is read by one task, so the passes over a table of few
    row groups would be the work of as few tasks, however many cores there are. Take
    narrow columns that hardly repeat together; a stream's batches are dealt too.
    """
    session = df.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    # By hash: dealing in turns would first sort what a task has read.
    return df.repartition(parts, *by)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session,
    as in tests, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession) -> str:
    """A new folder of its own under ``scratch_root``."""
    return f"{scratch_root(spark)}/run-{uuid.uuid4()}"
