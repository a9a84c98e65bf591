"""A Merkle manifest of a dataset: every row's leaf, its proof, and the root that the proof leads to.

The leaves of a group (a source) are the bottom of a tree of runs of three; the
groups' roots, in the groups' order, are the bottom of one tree more. Leaves
are numbered within their group by one range sort and the counts of its
partitions, so no group is ever the work of one task. A *superblock* is 6,561
leaves that follow each other; it is a whole subtree, as that is a power of
three. On the way up, superblocks become one node each, which are the
leaves of the next round. On the way down, each superblock is cogrouped with
the one row of outer nodes that its proofs need; that pass reduces the block
again, joins its proofs with the outer ones and folds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.common import col, settled, table

ARITY = 3
#: Levels of a superblock, which is 6,561 leaves.
HEIGHT = 8

NODE = "_key string, _pos long, _n long, _hash string"
OUTER = "_key string, _block long, _sub string, _root string, _path string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*columns: str) -> Column:
    """The leaf of a row: the digest of its values, each as ``-`` if null, else its length in bytes, ``:`` and itself."""
    texts = [col(c).cast("string") for c in columns]
    framed = (F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts)
    return F.sha2(F.concat(*framed), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof, an array of (left, right), lead to; for whoever checks a row later."""
    return F.aggregate(steps, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def _levels(hashes: list[str], n: int, height: int) -> list[list[str]]:
    """The levels of one superblock of a group of ``n`` nodes, up to its one top node."""
    levels = [hashes]
    while len(levels) <= height if n > ARITY**height else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[k : k + ARITY])) for k in range(0, len(below), ARITY)])
    return levels


def _steps(levels: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """Of the node at a place of the lowest level: the siblings to its left and right, level by level."""
    for level in levels[:-1]:
        first = at - at % ARITY
        yield "".join(level[first:at]), "".join(level[at + 1 : first + ARITY])
        at //= ARITY


def _top(block: pd.DataFrame, height: int) -> pd.DataFrame:
    block = block.sort_values("_pos")
    n, first, span = int(block["_n"].iat[0]), int(block["_pos"].iat[0]), ARITY**height
    top = _levels(block["_hash"].tolist(), n, height)[-1][0]
    return pd.DataFrame({"_key": [block["_key"].iat[0]], "_pos": [first // span], "_n": [-(-n // span)], "_hash": [top]})


def _paths(block: pd.DataFrame, outer: pd.DataFrame, height: int) -> tuple[pd.DataFrame, list[list[tuple[str, str]]]]:
    """The superblock's rows in order, and for each one its steps to the root."""
    block = block.sort_values("_pos")
    levels = _levels(block["_hash"].tolist(), int(block["_n"].iat[0]), height)
    rest = [tuple(x.split(",")) for x in outer["_path"].iat[0].split(";") if x]
    return block, [[*_steps(levels, at), *rest] for at in range(len(block))]


def _written(steps: list[tuple[str, str]]) -> str:
    return ";".join(f"{left},{right}" for left, right in steps)


def _inner(block: pd.DataFrame, outer: pd.DataFrame, height: int) -> pd.DataFrame:
    """The outer nodes of the superblocks below this one."""
    if block.empty or outer.empty:
        return pd.DataFrame(columns=["_key", "_block", "_sub", "_root", "_path"])
    block, paths = _paths(block, outer, height)
    return pd.DataFrame({
        "_key": block["_key"], "_block": block["_pos"], "_sub": outer["_sub"].iat[0], "_root": outer["_root"].iat[0],
        "_path": [_written(x) for x in paths],
    })


def _groups(block: pd.DataFrame, outer: pd.DataFrame, height: int) -> pd.DataFrame:
    """Of the tree of all groups: the outer nodes of each group's highest superblock."""
    if block.empty or outer.empty:
        return pd.DataFrame(columns=["_key", "_block", "_sub", "_root", "_path"])
    block, paths = _paths(block, outer, height)
    return pd.DataFrame({
        "_key": block["_name"], "_block": 0, "_sub": block["_hash"], "_root": outer["_root"].iat[0], "_path": [_written(x) for x in paths],
    })


def _rows(block: pd.DataFrame, outer: pd.DataFrame, height: int) -> pd.DataFrame:
    """Of the leaves: their proofs, and what the leaves to be checked fold to."""
    names = ["_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "_path"]
    if block.empty or outer.empty:
        return pd.DataFrame(columns=names)
    block, paths = _paths(block, outer, height)
    ends = []
    for node, steps in zip(block["_check"], paths, strict=True):
        for left, right in steps:
            node = digest(left + node + right)
        ends.append(node)
    return pd.DataFrame({
        "_id": block["_id"], "leaf": block["_hash"], "subroot": outer["_sub"].iat[0], "root": outer["_root"].iat[0],
        "proof_sha256": [digest("".join(x + y for x, y in steps)) for steps in paths],
        "folded_root": ends, "_path": [_written(x) for x in paths],
    })


def _placed(nodes: DataFrame, *order: Column) -> DataFrame:
    """``nodes`` with ``_pos``, their place within ``_key`` by ``order``, and ``_n``, how many there are.

    One range sort deals a large key over many partitions. A partition's rows
    are numbered as they stand; the counts of the partitions before it, one row
    for each key and partition, give the rest.
    """
    keys = [F.col("_key"), *order]
    ranged = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = settled(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    whole = Window.partitionBy("_key")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = ranged.groupBy("_key", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    heads = heads.select(
        "_key", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("_n"),
    )
    placed = ranged.join(heads, ["_key", "_part"])
    return settled(placed.withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"))


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("_block", F.expr(f"_pos div {ARITY**height}"))


def _rounds(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes, the tops of their superblocks, the tops of those, and so on until each key has one."""

    def top(block: pd.DataFrame) -> pd.DataFrame:
        return _top(block, height)

    most = nodes.agg(F.max("_n").alias("n")).first()["n"] or 0
    rounds = [nodes]
    while len(rounds) == 1 or most > 1:
        lower = _blocks(rounds[-1].select("_key", "_pos", "_n", "_hash"), height)
        rounds.append(settled(lower.groupBy("_key", "_block").applyInPandas(top, NODE)))
        most = -(-most // ARITY**height)
    return rounds


def _down(nodes: DataFrame, outer: DataFrame, function: Callable, schema: str, height: int) -> DataFrame:
    def finish(block: pd.DataFrame, needed: pd.DataFrame) -> pd.DataFrame:
        return function(block, needed, height)

    return _blocks(nodes, height).groupBy("_key", "_block").cogroup(outer.groupBy("_key", "_block")).applyInPandas(finish, schema)


def merkle_manifest(df: DataFrame, id_col: str, group_col: str, leaf: Column, check: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """One row for each row of ``df``: its id, ``leaf``, ``subroot``, ``root``, ``proof``, ``proof_sha256``, ``folded_root`` and ``verified``.

    ``leaf`` gives a row's digest, ``check`` the digest that is to be verified
    against the manifest (the leaf itself if there is none). ``proof`` holds
    the siblings on the left and right of each step to the root, ``folded_root``
    what ``check`` leads to with them. Within a group leaves ascend by id, nulls
    first, those of equal ids by leaf; groups ascend by the bytes of their name,
    the null one first. Equal rows stay rows of their own, with proofs of their
    own. An empty table gives an empty one; other columns are left out, whatever
    their names. The id is any type that a string casts back to.

    A superblock has at most 3 to the ``height`` rows of some 200 bytes. Texts do not travel.
    """
    named = df.select(
        F.when(col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), col(group_col).cast("string"))).alias("_key"),
        col(id_col).alias("_order"), leaf.alias("_hash"), F.coalesce(check if check is not None else leaf, leaf).alias("_check"),
        F.monotonically_increasing_id().alias("_row"),
    )
    placed = _placed(named, F.col("_order").asc_nulls_first(), F.col("_hash"), F.col("_row"))
    nodes = placed.select("_key", "_pos", "_n", "_hash", "_check", F.col("_order").cast("string").alias("_id"))
    rounds = _rounds(nodes, height)
    tops = rounds[-1].select(F.lit("").alias("_key"), F.col("_key").alias("_name"), "_hash")
    groups = _rounds(_placed(tops, F.col("_name")), height)
    root = groups[-1].select("_key", F.col("_pos").alias("_block"), F.lit("").alias("_sub"), F.col("_hash").alias("_root"), F.lit("").alias("_path"))
    for upper in groups[-2:0:-1]:
        root = _down(upper, root, _inner, OUTER, height)
    outer = _down(groups[0], root, _groups, OUTER, height)
    for upper in rounds[-2:0:-1]:
        outer = settled(_down(upper, outer, _inner, OUTER, height))
    done = _down(nodes, outer, _rows, "_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, _path string", height)
    steps = F.transform(F.filter(F.split("_path", ";"), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(","), F.lit(1)).alias("left"), F.split_part(x, F.lit(","), F.lit(2)).alias("right")))
    return done.select(
        F.col("_id").cast(df.schema[id_col].dataType).alias(id_col), "leaf", "subroot", "root", steps.alias("proof"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, checked against copies of which half have lost their line ends."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = docs.withColumn("_other", F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    done = merkle_manifest(
        other, "doc_id", "source", leaf_of("doc_id", "source", "lang", "n_chars", "text"), leaf_of("doc_id", "source", "lang", "n_chars", "_other")
    )
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _framed(*values: str) -> str:
    texts = (f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')" for x in values)
    return f"sha256({' || '.join(texts)})"


#: The checksum of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_transform(range(1, len(d) + 1), lambda i: CAST(ord(d[i]) AS BIGINT)), lambda c, b:
    list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295), 4294967295)"""
_STEP = """coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < p.pos // CAST(pow(3, t.lvl) AS BIGINT)), '') || ',' ||
    coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > p.pos // CAST(pow(3, t.lvl) AS BIGINT)), '')"""
_RUN = "t.n > 1 AND t.pos // 3 = p.pos // CAST(pow(3, t.lvl + 1) AS BIGINT)"

OP11_SQL = f"""
WITH RECURSIVE numbered AS (
    SELECT *, CAST(doc_id AS VARCHAR) AS d FROM documents
), tampered AS (
    SELECT *, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM numbered
), framed AS (
    SELECT doc_id, source, {_framed("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
        {_framed("doc_id", "source", "lang", "n_chars", "other")} AS chk FROM tampered
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM framed
), tree AS (
    SELECT source, 0 AS lvl, pos, leaf AS h, n FROM placed
    UNION ALL
    SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, lvl, pos // 3
), subs AS (
    SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
    SELECT 0 AS lvl, pos, subroot AS h, n FROM subs
    UNION ALL
    SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, pos // 3
), steps AS (
    SELECT p.source, p.pos, t.lvl, {_STEP} AS step FROM placed p JOIN tree t ON t.source IS NOT DISTINCT FROM p.source AND {_RUN} GROUP BY ALL
), outer_steps AS (
    SELECT p.source, t.lvl, {_STEP} AS step FROM subs p JOIN top t ON {_RUN} GROUP BY p.source, p.pos, t.lvl
), inner_paths AS (
    SELECT source, pos, list(step ORDER BY lvl) AS path FROM steps GROUP BY source, pos
), outer_paths AS (
    SELECT source, list(step ORDER BY lvl) AS path FROM outer_steps GROUP BY source
), proofs AS (
    SELECT p.doc_id, p.leaf, p.chk, s.subroot, (SELECT h FROM top WHERE n = 1) AS root, list_concat(coalesce(i.path, []), coalesce(o.path, [])) AS path
    FROM placed p JOIN subs s ON s.source IS NOT DISTINCT FROM p.source
    LEFT JOIN inner_paths i ON i.source IS NOT DISTINCT FROM p.source AND i.pos = p.pos
    LEFT JOIN outer_paths o ON o.source IS NOT DISTINCT FROM p.source
), folded AS (
    SELECT *, list_reduce(path, lambda node, x: sha256(split_part(x, ',', 1) || node || split_part(x, ',', 2)), chk) AS folded_root FROM proofs
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), ',', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
