"""Exact token counts of every prefix of a text, for a sentencepiece BPE model.

A sequence of tokens is the encoding of its text if and only if BPE leaves each
two that touch in it apart. So the last token of a prefix is the one token that
ends there and stays apart from the last token of the prefix before it, and the
count of a prefix is that one's count and one more: one pass from left to right
gives the counts of all prefixes, and later questions (how many tokens has this
part, where must the text be cut for a budget) need no encoding at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import col, table
from inkveil.llm.units import Memory

BLANK = "▁"
#: Pairs of tokens, and words, that a worker remembers; emptied when full.
PAIRS, WORDS = 500_000, 400_000
#: Bytes of text whose counts are handed on together.
BATCH_BYTES = 4 << 20


class Counter:
    """The counts that a model's merges imply.

    Of all neighbours whose text together is a piece, the pair with the best
    piece is joined first, the left one of equals. The model must fall back to
    bytes, leave the text as it is but for blanks, and put one blank in front.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        for probe in ("a  b ", " \t　\r\n x", "ﬁⅣéé"):
            if model.normalize(probe) != BLANK + probe.replace(" ", BLANK):
                raise ValueError(f"{path}: prefixes of the text are no prefixes of what the model encodes")
        if sum(map(model.is_byte, ids)) != 256:
            raise ValueError(f"{path}: the model does not fall back to bytes")
        pieces = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(BLANK in x.lstrip(BLANK) for x in pieces):
            raise ValueError(f"{path}: a piece has a blank behind other characters")
        if max(map(len, pieces)) > 100:
            raise ValueError(f"{path}: a piece is too long for differences of one byte")
        #: Of each piece: its place in the order of merges; equal scores share a place.
        places = {score: k for k, score in enumerate(sorted({s for x, s in pieces.items() if len(x) > 1}, reverse=True))}
        self.rank = {x: places[s] for x, s in pieces.items() if len(x) > 1}
        #: Of each piece that merging its own characters yields: the two pieces joined last.
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in pieces:
            if len(piece) > 1:
                parts = self._merged(piece)
                if len(parts) != 2:
                    continue
                if any(self.rank.get(x, -1) > self.rank[piece] for x in parts):
                    raise ValueError(f"{path}: {piece!r} is merged before its parts")
                self.halves[piece] = parts[0], parts[1]
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.known: dict[tuple[str, str], bool] = {}
        self.words = Memory(self._word, WORDS)
        self.units = re.compile(f"{BLANK}+[^{BLANK}]*")

    def _merged(self, piece: str) -> list[str]:
        """The two parts whose merge makes the piece, or where its merging ends otherwise."""
        parts = list(piece)
        while len(parts) > 1:
            ranks = [self.rank.get(x + y) for x, y in zip(parts, parts[1:])]  # noqa: B905
            first = min((r for r in ranks if r is not None), default=None)
            if first is None:
                return []
            if len(parts) == 2:
                break
            at = ranks.index(first)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays_apart(self, left: str, right: str) -> bool:
        """Whether the encoding of the two pieces' text is these two pieces.

        The merges beside the border are undone, the latest first. No merge
        across it may be due while the parts that touch there exist.
        """
        if (verdict := self.known.get((left, right))) is not None:
            return verdict
        x, y, due, verdict = left, right, len(self.rank) + 1, True
        while True:
            if self.rank.get(x + y, due) < due:
                verdict = False
                break
            made_x = self.rank[x] if x in self.halves else -1
            made_y = self.rank[y] if y in self.halves else -1
            if made_x < 0 and made_y < 0:
                break
            if made_x > made_y:  # of merges of one rank the left one is earlier
                due, x = made_x, self.halves[x][1]
            else:
                due, y = made_y + 1, self.halves[y][0]
        if len(self.known) >= PAIRS:
            self.known.clear()
        self.known[left, right] = verdict
        return verdict

    def _word(self, word: str) -> bytes:
        """By how many tokens each prefix of a word has more than the one before, as signed bytes."""
        counts, last, done = [0] * (len(word) + 1), [""] * (len(word) + 1), 0
        known = self.known
        for end, piece in self.automaton.iter(word):
            while done < end:  # a character that is no piece is as many tokens as it has bytes
                done += 1
                counts[done] = counts[done - 1] + len(word[done - 1].encode())
            if done > end:
                continue
            start = end + 1 - len(piece)
            before = last[start]
            if before:
                apart = known.get((before, piece))
                if apart is None:
                    apart = self.stays_apart(before, piece)
                if not apart:
                    continue
            done = end + 1
            last[done] = piece
            counts[done] = counts[start] + 1
        for k in range(done, len(word)):
            counts[k + 1] = counts[k] + len(word[k].encode())
        return bytes([(y - x) & 255 for x, y in zip(counts, counts[1:])])  # noqa: B905

    def __call__(self, text: str) -> np.ndarray:
        """The number of tokens of the first 0, 1, ... code points of the text."""
        if not text:
            return np.zeros(1, np.int32)
        # No piece reaches from a word into the blanks behind it, so words are counted each by itself.
        steps = b"".join(map(self.words.__getitem__, self.units.findall(BLANK + text.replace(" ", BLANK))))
        counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int32)
        counts[0] = 0  # an empty text has no token, not even the blank in front
        return counts


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker process."""
    return Counter(path)


def with_prefix_counts(df: DataFrame, text_col: str, out_col: str, path: str) -> DataFrame:
    """``df`` with an array: at place k the exact number of tokens of the text's first k code points.

    A null text counts as empty; an empty one has the array ``[0]``. ``path``
    names a model file that every executor can read. Special strings inside a
    text are ordinary text, as they are for the library. Each row is counted by
    itself and whole. A column of the name ``out_col`` is replaced; other names
    do not matter. No shuffle; memory is a batch of texts with four bytes for
    each of their characters.
    """
    names = [x for x in df.columns if x != out_col or x == text_col]
    # By place: names may hold dots.
    plain = df.select(*map(col, names)).toDF(*(f"c{k}" for k in range(len(names))))
    schema = T.StructType([*plain.schema, T.StructField("counts", T.ArrayType(T.IntegerType(), False), False)])
    at = names.index(text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of = counter(path)
        for batch in batches:
            begun, held, size = 0, [], 0
            for k, text in enumerate(batch.column(at)):
                text = text.as_py() or ""
                held.append(counts_of(text))
                size += len(text)
                if size >= BATCH_BYTES or k + 1 == batch.num_rows:
                    ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*batch.slice(begun, len(held)).columns, lists], schema.names)
                    begun, held, size = k + 1, [], 0

    counted = plain.mapInArrow(count, schema)
    kept = [F.col(f"c{k}").alias(x) for k, x in enumerate(names) if x != out_col]
    return counted.select(*kept, F.col("counts").alias(out_col))


def tokens_of(counts: Column) -> Column:
    """The number of tokens of the whole text."""
    return F.element_at(counts, -1)


def longest_within(counts: Column, budget: int | Column) -> Column:
    """How many code points a text may keep so that what stays has at most ``budget`` tokens.

    The longest such prefix: a longer one can have fewer tokens, as letters
    join. Zero if the budget is zero or less.
    """
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    fits = F.transform(counts, lambda n: (n <= limit).cast("int"))
    return F.greatest(F.lit(0), F.size(counts) - F.array_position(F.reverse(fits), 1).cast("int"))


def truncated(df: DataFrame, text_col: str, counts_col: str, budget: int, out_col: str) -> DataFrame:
    """``df`` with the longest prefix of each text that has at most ``budget`` tokens; the counts answer it."""
    return df.withColumn(out_col, F.substring(col(text_col), F.lit(1), longest_within(col(counts_col), budget)))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from the counts of their prefixes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = with_prefix_counts(docs, "text", "counts", public_tokenizers.path("piece_bpe_32k.model"))
    tokens = tokens_of(F.col("counts")).cast("long")
    return done.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), tokens.alias("n_tokens"), (tokens > 4096).alias("over_limit")
    )
