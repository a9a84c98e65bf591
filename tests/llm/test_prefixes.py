"""Prefix counts against the library that encodes each prefix anew."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from inkveil.llm import prefixes

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", " ", "  ", "▁", "\n", "\t", "a", "b", "the", "ing", "er", "é", "ß", "東", "京", "🙂", "<s>", "</s>", "<unk>", "<0x0A>", "12", "　", "=", "\0"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts() -> list[str | None]:
    rng = random.Random(4)
    out = [None, "", " ", "   ", "\n", "▁", "a", " " * 47, "x" * 300, "=" * 200]
    return out + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(150)]


def test_every_prefix(spark, model):
    rows = [(k, x, 1, 2) for k, x in enumerate(texts())]
    df = spark.createDataFrame([*rows, rows[3], (None, "a b", 1, 2)], "id long, text string, counts int, `a.b` int")
    done = prefixes.with_prefix_counts(df, "text", "counts", PATH)
    assert done.columns == ["id", "text", "a.b", "counts"]
    got = done.collect()
    assert len(got) == len(rows) + 2
    for row in got:
        text = row["text"] or ""
        assert row["counts"] == [len(model.encode(text[:k])) for k in range(len(text) + 1)]
    empty = prefixes.with_prefix_counts(df.where("false"), "text", "counts", PATH)
    assert empty.count() == 0


def test_batches_of_long_texts(spark, model, monkeypatch):
    monkeypatch.setattr(prefixes, "BATCH_BYTES", 50)
    rows = [(k, x) for k, x in enumerate([*texts(), "naïve words " * 5000])]
    done = prefixes.with_prefix_counts(spark.createDataFrame(rows, "id long, text string"), "text", "n", PATH)
    got = {r[0]: r[1] for r in done.select("id", prefixes.tokens_of(F.col("n"))).collect()}
    assert got == {k: len(model.encode(x or "")) for k, x in rows}


def test_budgets(spark, model):
    df = spark.createDataFrame([(x,) for x in texts()], "text string")
    done = prefixes.with_prefix_counts(df, "text", "n", PATH)
    for budget in (0, 1, 5, 1000):
        for row in prefixes.truncated(done, "text", "n", budget, "cut").collect():
            if row["text"] is None:
                assert row["cut"] is None
                continue
            text = row["text"]
            fitting = [k for k in range(len(text) + 1) if len(model.encode(text[:k])) <= budget]
            assert row["cut"] == text[: max(fitting)]


def test_query(spark, model, tmp_path):
    rows = [(k, x) for k, x in enumerate([*texts(), "über alles " * 1500])] + [(None, "a"), (3, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("counts", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, prefixes.op12_token_counts(spark, str(tmp_path)).collect()), key=repr)
    n = [(i, len((x or "").encode()), len(model.encode(x or ""))) for i, x in rows]
    assert got == sorted(((*r, r[2] > 4096) for r in n), key=repr)
