"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import shared_folder
from inkveil.llm.langid import UNKNOWN, told
from inkveil.llm.packing import packed_pieces
from inkveil.llm.secrets import without_secrets
from inkveil.llm.simhash import one_of_each
from inkveil.llm.substrings import without_repeats

#: Rows that a task and its Python worker pass each other at once. Texts are long: Spark's 10,000 are some 40 MB on either
#: side, in several copies, and stay with the executor for all stages.
ROWS_AT_ONCE = 1000
#: A document goes if no language has this share of its words; clean text of one language has far more.
LEAST_SHARE = 0.3


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Python workers get ROWS_AT_ONCE rows at a time, or fewer if it asks for fewer."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS_AT_ONCE:
        conf.set(name, str(ROWS_AT_ONCE))
    return docs


def counted(docs: DataFrame) -> DataFrame:
    """The texts' lengths anew, after the texts have changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null and letterless texts and those of no one language go."""
    rest = F.struct(*(c for c in docs.columns if c != "text"), F.lit(0).alias("_"))  # each text is held once
    named = told(in_small_batches(docs).withColumn("_row", rest).select("_row", "doc_id", "text", "lang"))
    kept = named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select(*(F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns))


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    return one_of_each(in_small_batches(docs), "doc_id", "text", 3, 2)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that an earlier one has."""
    return counted(without_repeats(in_small_batches(docs), "doc_id", "text"))


def unsecret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return counted(without_secrets(in_small_batches(docs), "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences."""
    return packed_pieces(in_small_batches(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("simhash_dedup", near_unique),
    ("suffix_array_dedup", unrepeated),
    ("secret_scan", unsecret),
    ("packing", packed),
]

#: SQL has no way to say what a field of learned weights decides.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on ``documents``, each one's rows handed on as Parquet in the cluster's shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
