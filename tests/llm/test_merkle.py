"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from inkveil.llm import merkle


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(values) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top of a tree, and each node's siblings on the way."""
    steps = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            first = place // 3 * 3
            steps[k].append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 3])))
        nodes = [h("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
        at = [x // 3 for x in at]
    return (nodes[0] if nodes else ""), steps


def manifest(rows: list[tuple]) -> list[tuple]:
    """Rows are (doc_id, source, lang, n_chars, text)."""
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        group = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, framed(r)))
        trees[name] = group, *climb([framed(r) for r in group])
    root, outer = climb([trees[x][1] for x in names])
    out = []
    for name, rest in zip(names, outer, strict=True):
        group, subroot, steps = trees[name]
        for row, own in zip(group, steps, strict=True):
            path = own + rest
            doc_id, source, lang, n_chars, text = row
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = framed((doc_id, source, lang, n_chars, text))
            for left, right in path:
                node = h(left + node + right)
            out.append((doc_id, framed(row), subroot, root, h("".join(x + y for x, y in path)), node, node == root))
    return out


NAMES = "doc_id long, source string, lang string, n_chars long, text string"


def query(spark, rows, tmp_path, extra=()):
    df = spark.createDataFrame(rows, NAMES)
    for name in extra:
        df = df.withColumn(name, F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return merkle.op11_merkle_manifest(spark, str(tmp_path))


def sample(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = None if k % 11 == 0 else "hot" if k % 3 == 0 else rng.choice(["", "b", "ä", "Z", "=", f"s{k % 5}"])
        text = rng.choice([None, "", "x", "one\ntwo", "naïve\n", "東京"])
        rows.append((None if k % 37 == 5 else rng.randrange(3 * n), source, rng.choice([None, "en"]), rng.choice([None, k]), text))
    return [*rows, rows[0], rows[0], rows[5], (7, "alone", "en", 3, "a\nb")]


@pytest.mark.parametrize("n", [0, 1, 2, 400])
def test_against_a_plain_tree(spark, tmp_path, n):
    rows = sample(n, n) if n > 2 else [(k, "s", "en", 1, "a\n") for k in range(n)]
    got = query(spark, rows, tmp_path, ("_key", "_hash", "leaf", "root", "_at")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(manifest(rows), key=repr)


def test_superblocks_of_several_rounds(spark):
    """With superblocks of nine leaves, 400 rows take several rounds up and down."""
    rows = sample(400, 3)
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    df = spark.createDataFrame(rows, NAMES).withColumn("other", other)
    names = ("doc_id", "source", "lang", "n_chars")
    got = merkle.merkle_manifest(df, "doc_id", "source", merkle.leaf_of(*names, "text"), merkle.leaf_of(*names, "other"), height=2).drop("proof").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(manifest(rows), key=repr)


def test_proofs_can_be_checked_later(spark):
    df = spark.createDataFrame(sample(50, 9), NAMES)
    done = merkle.merkle_manifest(df, "doc_id", "source", merkle.leaf_of("doc_id", "text"))
    bad = done.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count()
    assert done.where("verified").count() == df.count() and bad == 0
    assert done.select("root").distinct().count() == 1
