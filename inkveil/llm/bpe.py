"""Byte-level BPE by backtracking over longest matches.

An encoding is right if and only if BPE leaves each two tokens that touch in it
apart. So the encoder takes the longest token that starts at a place and stays
apart from the one before, and steps back where none does; no place is left
twice, which makes it linear in the length. A trie over the tokens' bytes, read
as Latin-1, tells the longest token at a place; it is asked only at places that
a token has reached.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import col, table
from inkveil.llm.units import Units, little

#: Pairs of a token and what may come after it that are remembered, and words and pieces that a worker remembers.
PAIRS, WORDS = 1_000_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Following(dict):
    """What comes after a token (-1: at the start), by the longest one at its place: the longest, of it and those that start it, that stays apart from the one before."""

    __slots__ = ("bpe", "before")

    def __init__(self, bpe: Bpe, before: int) -> None:
        super().__init__()
        self.bpe, self.before = bpe, before

    def __missing__(self, token: int | None) -> int | None:
        if token is None or self.before < 0:
            return token
        fits = token if self.bpe.stays_apart(self.before, token) else self[self.bpe.shorter[token]]
        self.bpe.remembered()
        self[token] = fits
        return fits


class Bpe:
    """The merges that a table of ranks implies: the two neighbours whose bytes together have the least rank are joined first, the left ones of equals."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        #: Of each token that merging its own bytes yields: the two tokens joined last.
        self.halves: dict[int, tuple[int, int]] = {}
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self.merged(token, 2)
                if len(parts) != 2 or parts[0] + parts[1] != token:
                    continue
                self.halves[rank] = ranks[parts[0]], ranks[parts[1]]
            self.trie.add_word(token.decode("latin-1"), rank)
        self.widest = max(map(len, ranks), default=0)
        #: Of each beginning of a token: the longest token that starts it, itself included.
        self.starts: dict[str, int] = {}
        for token in sorted(self.trie.keys()):
            found = None
            for n in range(1, len(token) + 1):
                found = self.trie.get(token[:n], found)
                if found is not None:
                    self.starts[token[:n]] = found
        #: Of each token: the longest one that starts it and is shorter.
        self.shorter = {rank: self.starts.get(token[:-1]) for token, rank in self.trie.items()}
        self.following = {rank: Following(self, rank) for rank in (-1, *self.shorter)}
        self.pairs = 0

    def merged(self, piece: bytes, least: int) -> list[bytes]:
        """Merges step by step, down to ``least`` parts; for tokens only, as its work is quadratic."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > least:
            ranks = [self.ranks.get(x + y) for x, y in zip(parts, parts[1:])]  # noqa: B905
            first = min((r for r in ranks if r is not None), default=None)
            if first is None:
                break
            at = ranks.index(first)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives these two tokens.

        Merges are undone at the border, the latest first. Between the time when
        the parts that touch have come to be and the time when one is merged
        into its token, no merge across the border may be due.
        """
        x, y, until = left, right, 1 << 62
        while True:
            across = self.ranks.get(self.bytes[x] + self.bytes[y])
            if across is not None and across < until:
                return False
            made_x = x if x in self.halves else -1
            made_y = y if y in self.halves else -1
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:  # of equal ranks the left pair goes first, so a merge across comes after one in x
                until, x = made_x, self.halves[x][1]
            else:
                until, y = made_y + 1, self.halves[y][0]

    def remembered(self) -> None:
        """Counts a pair of tokens; all are forgotten when they are too many."""
        if self.pairs >= PAIRS:
            for after in self.following.values():
                after.clear()
            self.pairs = 0
        self.pairs += 1

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one match of the pattern; a piece that is a token by itself is not merged."""
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        text, size = piece.decode("latin-1"), len(piece)
        longest_prefix, widest, starts, lengths, following = self.trie.longest_prefix, self.widest, self.starts, self.lengths, self.following
        tokens: list[int] = []
        dead: set[int] = set()
        at, after, token = 0, following[-1], starts.get(text[: longest_prefix(text[:widest])])
        while at < size:
            token = after[token]
            if token is None:  # nothing fits here: leave the place for good and shorten the token before
                dead.add(at)
                token = tokens.pop()
                at -= lengths[token]
                token, after = self.shorter[token], following[tokens[-1] if tokens else -1]
            elif (end := at + lengths[token]) in dead:
                token = self.shorter[token]
            else:
                tokens.append(token)
                at, after = end, following[token]
                rest = text[at : at + widest]
                token = starts.get(rest[: longest_prefix(rest)])
        return tokens


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, path: str, pattern: str) -> None:
        self.bpe = Bpe(read_ranks(path))
        self.encode = Units(pattern, lambda piece: little(self.bpe.encode(piece.encode())), WORDS)
        self.tokens = pa.array(map(self.bpe.bytes.get, range(max(self.bpe.bytes, default=-1) + 1)), pa.binary())

    def decode(self, ids: bytes) -> bytes:
        """The tokens' bytes lie side by side once Arrow has taken them by their ids."""
        if not ids:
            return b""
        taken = self.tokens.take(pa.array(np.frombuffer(ids, "<u4")))
        if taken.null_count:
            raise KeyError("an id that no token has")
        _, ends, data = taken.buffers()
        return data[: int(np.frombuffer(ends, np.int32)[len(taken)])].to_pybytes()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


def with_ids(df: DataFrame, text_col: str, out_col: str, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with each text's ids as the bytes of little-endian unsigned 32-bit integers; a null or empty text has none.

    ``path`` names a vocabulary file of ranks that every executor can read. Each
    row is encoded by itself and whole; special tokens are not known.
    """

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        to_ids = encoder(path, pattern).encode
        return pa.array([to_ids(x or "") for x in texts.to_pylist()], pa.binary())

    return df.withColumn(out_col, encode(col(text_col)))


def with_decoded(df: DataFrame, ids_col: str, out_col: str, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with the bytes that the ids stand for; null ids stand for none."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        to_bytes = encoder(path, pattern).decode
        return pa.array([to_bytes(x or b"") for x in ids.to_pylist()], pa.binary())

    return df.withColumn(out_col, decode(col(ids_col)))


def with_round_trip(df: DataFrame, text_col: str, out_col: str, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with a struct of each text's ``ids``, as ``with_ids`` has them, and of ``decoded``, the bytes that they stand for: one pass for both."""

    @F.arrow_udf("struct<ids: binary, decoded: binary>")
    def both(texts: pa.Array) -> pa.Array:
        known = encoder(path, pattern)
        ids = [known.encode(x or "") for x in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(known.decode, ids), pa.binary())], ["ids", "decoded"])

    return df.withColumn(out_col, both(col(text_col)))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = with_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "bpe", path)
    tokens = (F.octet_length("bpe.ids") / F.lit(4)).cast("long")
    return done.select("doc_id", tokens.alias("n_tokens"), F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"))
