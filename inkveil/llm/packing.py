"""Sum-of-squares online packing of documents into sequences of a fixed length.

Each document goes where it makes the sum of the squared counts of partially
filled sequences least, over their fill levels; the counts lie in an array with
a place for each level. What is still open at the end is poured together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkveil.llm.common import col, table
from inkveil.llm.units import Units, little

#: Documents, and bytes of text, that one task packs together.
GROUP, GROUP_BYTES = 8192, 32 << 20
#: Texts that a task holds as strings at once.
TOGETHER = 256
#: A run of blanks that is taken with more care.
RUN = 20_000
BLANKS = re.compile(rf"\s{{{RUN}}}")
PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for: printable ones for themselves, the others for those from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Ids:
    """Texts to the ids of a byte-level BPE file, as little-endian unsigned 32-bit integers; strings of special tokens in a text are ordinary text.

    The file's merges, in order, are the ranks of the tokens that they make, and
    every token comes of its own bytes by them. So joining the neighbours of the
    least rank, which takes a fraction of the time, gives the file's ids.
    """

    def __init__(self, path: str) -> None:
        slow = Tokenizer.from_file(path)
        slow.encode_special_tokens = True
        model = json.loads(slow.to_str())["model"]
        merged = [model["vocab"]["".join(x) if isinstance(x, list) else x.replace(" ", "")] for x in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids are not in the order of merges")
        known, special = byte_of(), {x.content for x in slow.get_added_tokens_decoder().values()}
        ranks = {bytes(map(known.__getitem__, token)): rank for token, rank in model["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: For texts with runs of blanks that the pattern of the other one can't take.
        self.units = Units(public_tokenizers.PATTERN, lambda piece: little(slow.encode(piece, add_special_tokens=False).ids))

    def __call__(self, text: str) -> bytes:
        if len(text) > RUN and BLANKS.search(text):
            return self.units(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Ids:
    """One for each worker process."""
    return Ids(path)


def with_ids(df: DataFrame, text_col: str, out_col: str, path: str, end_id: int) -> DataFrame:
    """``df`` with each text's ids and ``end_id`` as the bytes of little-endian unsigned 32-bit integers; a null text is an empty one."""

    @F.arrow_udf("binary")
    def tokenize(texts: pa.Array) -> pa.Array:
        to_ids, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        parts = (texts.slice(low, TOGETHER).to_pylist() for low in range(0, len(texts), TOGETHER))
        return pa.array([to_ids(x or "") + end for part in parts for x in part], pa.binary())

    return df.withColumn(out_col, tokenize(col(text_col)))


class Levels:
    """Open sequences by fill level; ``counts[h]`` are those filled to h."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.counts = np.zeros(size, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size)]
        self.n = 0

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset in it for an item shorter than a sequence; of equals the fullest wins."""
        last = self.size - length  # a sequence filled to here is full with the item
        changes = np.full(last + 1, np.iinfo(np.int64).max)
        used = np.flatnonzero(self.counts[: last + 1])
        after = np.r_[self.counts[length:] * 2 + 1, 0]  # joining level h + length; a full sequence counts no more
        changes[used] = 1 - 2 * self.counts[used] + after[used]
        changes[0] = after[0]
        level = last - int(np.argmin(changes[::-1]))
        if level:
            sequence = self.open[level].pop()
            self.counts[level] -= 1
        else:
            sequence, self.n = self.n, self.n + 1
        if level + length < self.size:
            self.open[level + length].append(sequence)
            self.counts[level + length] += 1
        return sequence, level


def pack(lengths: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(item, start, length, sequence, offset)`` of items of these lengths, in sequences of at most ``size``.

    An item is cut into full sequences and a rest, which is placed online. The
    rests in sequences that stay open are poured, the fullest sequence first,
    into new ones that are filled to the brim; only the last of them is not full.
    """
    levels, pieces, members = Levels(size), [], {}
    for item, length in enumerate(lengths):
        whole = length - length % size
        for start in range(0, whole, size):
            pieces.append((item, start, size, levels.n, 0))
            levels.n += 1
        if length > whole:
            sequence, offset = levels.place(length - whole)
            members.setdefault(sequence, []).append((item, whole, length - whole, offset))
    filled = {q: sum(x[2] for x in members[q]) for q in members}
    for sequence in [q for q in members if filled[q] == size]:
        pieces += [(i, s, n, sequence, o) for i, s, n, o in members.pop(sequence)]
    names = sorted(members)  # the numbers of what is poured are given anew
    fill, used = 0, 0
    for sequence in sorted(members, key=lambda q: -filled[q]):
        for item, start, length, _ in members[sequence]:
            while length:
                part = min(length, size - fill)
                pieces.append((item, start, part, names[used], fill))
                start, length, fill = start + part, length - part, fill + part
                if fill == size:
                    used, fill = used + 1, 0
    return pieces


def _packer(size: int) -> Callable[[pa.Table], pa.Table]:
    def packed(part: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        part = part.sort_by("row")
        ids, group = part["ids"].to_pylist(), part["group"][0].as_py()
        pieces = pack([len(x) // 4 for x in ids], size)
        item, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        return pa.table({
            "id": part["id"].take(pa.array(item)), "start": start, "length": length, "doc_tokens": np.array([len(x) // 4 for x in ids], np.int64)[item],
            "sequence_id": sequence + (group << 32), "offset": offset, "ids": pa.array([ids[i][4 * s : 4 * (s + n)] for i, s, n, *_ in pieces], pa.binary()),
        })

    return packed


def pack_documents(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, size: int = 2048, group: int = GROUP) -> DataFrame:
    """``(id, start, length, doc_tokens, sequence_id, offset, ids)``: one row per piece, the id under the name of ``id_col``.

    A document's ids are those of its whole text and ``end_id``, so an empty or
    null text still has one. Each id lies in exactly one piece. Rows are dealt
    evenly to groups of about ``group`` by their place in the table, not by their
    values, so that repeated rows, each packed for itself, make no group larger,
    and to more groups where texts are long, about ``GROUP_BYTES`` of text in each.
    Other columns are left out, whatever their names. An empty table gives no piece.
    """
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = with_ids(rows, "text", "ids", path, end_id).select("id", "row", "ids")
    n, size_of = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(col(text_col)).cast("long")), F.lit(0))).first()
    groups = max(1, -(-n // group), -(-size_of // GROUP_BYTES))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    done = rows.groupBy("group").applyInArrow(_packer(size), f"id long, {PIECE}")
    return done.withColumnRenamed("id", id_col)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of documents at 2048 tokens, with a checksum of their ids."""
    done = pack_documents(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), 1, 2048)
    return done.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return packed_pieces(table(spark, sf_dir, "documents"))
