"""Exact substring deduplication with suffix arrays.

A byte goes if a string of ``least`` bytes that covers it also starts in a
document with a smaller id. Each such string has an anchor, the place of its
least hashed run of ANCHOR bytes, which depends on the string alone. Strings of a
document with one anchor lie in one short stretch, and equal strings of
different documents in stretches with equal anchors:

1. anchors that stand in one place only are ruled out by their hashes;
2. the stretches of all other anchors go to tasks by anchor, equal ones of a part
   of the documents as one;
3. a task cuts from each stretch what no other of its anchor shares, and the
   suffix array of the rest brings equal strings together;
4. each part gets a mask of the strings of its stretches that a smaller id has.

An anchor that stands in very many places (as a passage does that a third of all
documents share) would fill a task with stretches. Its strings are dealt each by
itself instead, of which a part sends equal ones once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import col, quoted, table
from inkveil.llm.suffixes import suffix_array

LEAST = 50
#: Bytes of an anchor, of a chunk that is hashed at once, and of the texts of a part.
ANCHOR, CHUNK, PART_BYTES = 24, 1 << 17, 8 << 20
#: Anchors that a task holds before it sends them, and places from which on an anchor's strings are dealt one by one.
HELD, HOT = 1 << 20, 1 << 14
#: Bytes whose suffixes are sorted together; stretches with one anchor stay together.
SORTED = 1 << 17
NO_ID = np.iinfo(np.int64).max
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


class Shape(NamedTuple):
    """Sizes that follow from the length of strings: strings with one anchor, and bytes of the longest stretch and of its row in 8-byte words."""

    least: int
    strings: int
    longest: int
    row: int


def shape(least: int) -> Shape:
    if least < ANCHOR + 8:
        raise ValueError(f"strings of at least {ANCHOR + 8} bytes are needed")
    strings = least - ANCHOR + 1
    if strings > 128:
        raise ValueError(f"strings of at most {ANCHOR + 127} bytes are supported")
    longest = least + strings - 1
    return Shape(least, strings, longest, -(-(longest + 2) // 8) * 8)


class Chunk(NamedTuple):
    """Stretches of some texts: the bytes, each one's row, first and last start of a string, its anchor's hash and key, and the hashes of all places."""

    buffer: np.ndarray
    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    least: np.ndarray
    key: np.ndarray
    hashes: np.ndarray
    offset: np.ndarray


def hashed(words: np.ndarray) -> np.ndarray:
    """A hash of each row of 8-byte words."""
    total = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        total = (total ^ words[:, k]) * MIX[k % 4]
        total ^= total >> np.uint64(31)
    return total


def eights(buffer: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there on, but for the last seven places."""
    words = np.empty(len(buffer) - 7, np.uint64)
    raw = buffer.tobytes()
    for shift in range(8):
        words[shift::8] = np.frombuffer(raw, "<u8", (len(buffer) - shift) // 8, shift)
    return words


def chunks(texts: list[bytes], sizes: Shape) -> Iterator[Chunk]:
    """The stretches of texts; long texts come in pieces that overlap by a string less one byte."""
    held: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    size = 0
    for row, text in enumerate(texts):
        at = 0
        while len(text) - at >= sizes.least:
            piece = text[at : at + CHUNK + sizes.least - 1]
            held.append(piece)
            rows.append(row)
            offsets.append(at)
            size += len(piece)
            at += CHUNK
            if size >= CHUNK:
                yield _chunk(held, rows, offsets, sizes)
                held, rows, offsets, size = [], [], [], 0
    if held:
        yield _chunk(held, rows, offsets, sizes)


def _chunk(pieces: list[bytes], rows: list[int], offsets: list[int], sizes: Shape) -> Chunk:
    joined = b"".join(pieces)
    n = len(joined)
    buffer = np.frombuffer(joined + bytes(16), np.uint8)
    words = eights(buffer)
    places = n - ANCHOR + 1
    hashes = words[:places] * MIX[0]
    hashes += words[8 : 8 + places] * MIX[1]
    hashes += words[16 : 16 + places] * MIX[2]
    hashes ^= hashes >> np.uint64(29)
    hashes *= MIX[3]
    hashes ^= hashes >> np.uint64(32)
    least, span = hashes, 1
    while 2 * span <= sizes.strings:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < sizes.strings:
        gap = sizes.strings - span
        least = np.minimum(least[:-gap], least[gap:])
    ends = np.cumsum([len(x) for x in pieces])
    begins = np.r_[0, ends[:-1]]
    new = np.empty(len(least), bool)
    new[0] = True
    # an anchor that falls out of the string makes way for an equal one after it
    np.logical_or(least[1:] != least[:-1], hashes[: len(least) - 1] == least[1:], out=new[1:])
    new[begins] = True
    for end in ends[:-1].tolist():
        new[end - sizes.least + 1 : end] = False
    first = np.flatnonzero(new)
    piece = np.searchsorted(begins, first, "right") - 1
    last = np.minimum(np.r_[first[1:] - 1, n], ends[piece] - sizes.least)
    # least hashes are small ones; their keys are spread evenly
    return Chunk(buffer, np.array(rows)[piece], first, last, least[first], least[first] * MIX[1], hashes, np.array(offsets)[piece] - begins[piece])


class Stretches(NamedTuple):
    """Rows of fixed width: bytes around the anchor, zero outside the stretch, then the numbers of bytes before and after it. With it the row of the text and the stretch's first string."""

    words: np.ndarray
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray


#: Set in the number of bytes after an anchor if the stretch is a string by itself.
ALONE = 0x80


def stretches(texts: list[bytes], known: np.ndarray, hot: np.ndarray, sizes: Shape) -> Stretches:
    """The stretches with a known anchor; those with a hot one string by string."""
    found: list[tuple[np.ndarray, ...]] = []
    reach = sizes.strings - 1
    across = np.arange(sizes.longest)
    for chunk in chunks(texts, sizes):
        if not len(known):
            break
        at = np.minimum(np.searchsorted(known, chunk.key), len(known) - 1)
        mine = np.flatnonzero(known[at] == chunk.key)
        if not len(mine):
            continue
        first, last, least, row, offset, alone = chunk.first[mine], chunk.last[mine], chunk.least[mine], chunk.row[mine], chunk.offset[mine], hot[at[mine]]
        window = np.minimum(last[:, None] + np.arange(sizes.strings), len(chunk.hashes) - 1)
        anchor = last + np.argmax(chunk.hashes[window] == least[:, None], axis=1)
        if alone.any():
            times = np.where(alone, last - first + 1, 1)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            first, last, anchor, row, offset, alone = (np.repeat(x, times) for x in (first, last, anchor, row, offset, alone))
            first = first + step
            last = np.where(alone, first, last)
        before, after = anchor - first, last + sizes.least - anchor - ANCHOR
        places = (anchor - reach)[:, None] + across
        body = chunk.buffer[np.clip(places, 0, len(chunk.buffer) - 1)]
        body[(across < (reach - before)[:, None]) | (across >= (reach + ANCHOR + after)[:, None])] = 0
        out = np.zeros((len(body), sizes.row), np.uint8)
        out[:, : sizes.longest] = body
        out[:, -2], out[:, -1] = before, after | alone * ALONE
        found.append((out.view("<u8"), row, first + offset, last - first + 1))
    if not found:
        return Stretches(np.zeros((0, sizes.row // 8), np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    return Stretches(*(np.concatenate(x) for x in zip(*found, strict=True)))


def anchor_hashes(rows: np.ndarray, sizes: Shape) -> np.ndarray:
    """The bucket hash of stretches: that of the anchor, or of the whole string of a stretch that is one by itself."""
    raw = np.ascontiguousarray(rows).view(np.uint8)
    reach = sizes.strings - 1
    own = hashed(np.ascontiguousarray(raw[:, reach : reach + ANCHOR]).view("<u8"))
    return np.where(raw[:, -1] & ALONE, hashed(rows), own)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        differ = x[1:] != x[:-1]
        new[1:] |= differ.any(axis=1) if x.ndim == 2 else differ
    return new


class Unique(NamedTuple):
    """Distinct stretches by bucket hash, the least id that has each, and the number of each of the rows given."""

    words: np.ndarray
    key: np.ndarray
    least: np.ndarray
    number: np.ndarray


def unique(words: np.ndarray, ids: np.ndarray, sizes: Shape) -> Unique:
    key = anchor_hashes(words, sizes)
    order = np.lexsort((hashed(words), key))
    sorted_words = words[order]
    new = _changes(sorted_words)
    at = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], at) if len(at) else ids
    return Unique(sorted_words[at], key[order][at], least, number)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by rising hash."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(_changes(*columns))
    return starts, np.r_[starts[1:], len(columns[0])][: len(starts)]


def _blobs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())


def _joined(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


# 1. anchors


def _anchors(buckets: int, sizes: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per part and bucket: the distinct hashes of anchors; the bits of a count that is not below their places, and whether they stand in several rows."""

    def send(part: np.ndarray, key: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((row, key, part))
        part, key, row = part[order], key[order], row[order]
        new = _changes(part, key)
        at = np.flatnonzero(new)
        ends = np.r_[at[1:], len(key)]
        note = np.ceil(np.log2(ends - at)).astype(np.uint8) | (row[at] != row[ends - 1]) * np.uint8(128)
        part, key = part[at], key[at]
        bucket = _bucket(key, buckets)
        starts, ends = _runs(part, bucket)
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(part[starts]), _blobs(key, starts, ends), _blobs(note, starts, ends)], ["bucket", "part", "keys", "notes"])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, rows = 0, 0
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            parts = batch.column("part").to_numpy()
            for chunk in chunks([x or b"" for x in batch.column("text").to_pylist()], sizes):
                held.append((parts[chunk.row], chunk.key, chunk.row + rows))
                size += len(chunk.key)
                if size >= HELD:
                    yield send(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
            rows += batch.num_rows
        if held:
            yield send(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return anchors


def _shared(hot: int) -> Callable[[pa.Table], pa.Table]:
    def shared(bucket: pa.Table) -> pa.Table:
        """Per part: its anchors that stand in several rows, and which of them are hot."""
        key, note = _joined(bucket["keys"], "<u8"), _joined(bucket["notes"], "u1")
        sizes = np.array([len(x) // 8 for x in bucket["keys"].to_pylist()])
        part = np.repeat(bucket["part"].to_numpy(), sizes)
        order = np.argsort(key, kind="stable")
        starts, ends = _runs(key[order])
        several = (ends - starts > 1) | (np.maximum.reduceat(note[order], starts) >= 128)
        places = np.add.reduceat(np.left_shift(1, (note[order] & 127).astype(np.int64)), starts)
        group = np.repeat(np.arange(len(starts)), ends - starts)
        kept = order[several[group]]
        is_hot = (places > hot)[group][several[group]]
        order = np.lexsort((key[kept], part[kept]))
        kept, is_hot = kept[order], is_hot[order]
        if not len(kept):
            return pa.table({"part": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "hot": pa.array([], pa.binary())})
        starts, ends = _runs(part[kept])
        return pa.table({"part": part[kept][starts], "keys": _blobs(key[kept], starts, ends), "hot": _blobs(is_hot, starts, ends)})

    return shared


def _known(notes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, hot = _joined(notes["keys"], "<u8"), _joined(notes["hot"], "?")
    order = np.argsort(key, kind="stable")
    key, hot = key[order], hot[order]
    at = np.flatnonzero(_changes(key))
    return key[at], hot[at]  # an anchor is hot in all notes or in none


def _texts(docs: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts; a text without an id neither lends nor loses, and is taken as empty."""
    ids = docs["id"].fill_null(NO_ID).to_numpy()
    return ids, [(x or b"") if i != NO_ID else b"" for i, x in zip(ids.tolist(), docs["text"].to_pylist(), strict=True)]


# 2. stretches


def _stretches(buckets: int, sizes: Shape) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def sent(docs: pa.Table, notes: pa.Table) -> pa.Table:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        ids, texts = _texts(docs)
        found = stretches(texts, *_known(notes), sizes)
        mine = unique(found.words, ids[found.row], sizes)
        bucket = _bucket(mine.key, buckets)
        starts, ends = _runs(bucket)
        part = docs["part"][0].as_py() if len(docs) else 0
        return pa.table({"bucket": bucket[starts], "part": pa.array([part] * len(starts), pa.int64()), "words": pa.array([squeeze(mine.words[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()), "ids": _blobs(mine.least, starts, ends)})

    return sent


# 3. equal strings


def _shared_length(key: np.ndarray, text: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each row of bytes, the longest beginning that it shares with another row of its key; at most ``own``."""
    width = -(-text.shape[1] // 8) * 8
    padded = np.zeros((len(text), width), np.uint8)
    padded[:, : text.shape[1]] = text
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), key))
    same = text[order[1:]] == text[order[:-1]]
    common = np.where(same.all(axis=1), text.shape[1], np.argmin(same, axis=1))
    common[key[order[1:]] != key[order[:-1]]] = -1
    best = np.maximum(np.r_[common, -1], np.r_[-1, common])
    out = np.empty(len(order), np.int64)
    out[order] = best
    return np.minimum(out, own)


def least_ids(words: np.ndarray, key: np.ndarray, ids: np.ndarray, sizes: Shape) -> np.ndarray:
    """For each of the distinct stretches and each of its strings: the least id that has the string."""
    raw = np.ascontiguousarray(words).view(np.uint8)
    reach = sizes.strings - 1
    before, after = raw[:, -2].astype(np.int64), (raw[:, -1] & (ALONE - 1)).astype(np.int64)
    result = np.repeat(ids[:, None], sizes.strings, axis=1)
    starts, ends = _runs(key)
    many = np.flatnonzero(np.repeat(ends - starts > 1, ends - starts))
    if not len(many):
        return result
    body, own_key = raw[many], key[many]
    right = _shared_length(own_key, body[:, reach + ANCHOR : sizes.longest], after[many])
    left = _shared_length(own_key, body[:, :reach][:, ::-1], before[many])
    enough = left + ANCHOR + right >= sizes.least
    many, body, right, left = many[enough], body[enough], right[enough], left[enough]
    if not len(many):
        return result
    # what a stretch shares with others; equal ones as one again
    across = np.arange(sizes.longest)
    cut = np.zeros((len(body), sizes.row), np.uint8)
    cut[:, : sizes.longest] = np.where((across >= (reach - left)[:, None]) & (across < (reach + ANCHOR + right)[:, None]), body[:, : sizes.longest], 0)
    cut[:, -2], cut[:, -1] = left, right
    rows = cut.view("<u8")
    order = np.lexsort((hashed(rows), own_key[enough]))
    new = _changes(rows[order])
    at = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    distinct, low, own_key = cut[order[at]], np.minimum.reduceat(ids[many][order], at), own_key[enough][order[at]]
    begin = reach - distinct[:, -2].astype(np.int64)
    lengths = distinct[:, -2].astype(np.int64) + ANCHOR + distinct[:, -1]
    found = np.empty((len(distinct), sizes.strings), np.int64)
    borders = np.r_[_runs(own_key)[0], len(own_key)]
    sums = np.r_[0, np.cumsum(lengths)]
    start = 0
    while start < len(distinct):
        past = borders[np.searchsorted(borders, start, "right") :]
        end = int(past[np.searchsorted(sums[past], sums[start] + SORTED, "right") - 1]) if sums[past[0]] <= sums[start] + SORTED else int(past[0])
        some = slice(start, end)
        found[some] = _by_suffixes(distinct[some, : sizes.longest], begin[some], lengths[some], low[some], sizes)
        start = end
    mine = found[number]
    skip = before[many] - left
    for k in range(sizes.strings):
        place = k - skip
        ok = (place >= 0) & (place <= left + ANCHOR + right - sizes.least)
        result[many[ok], k] = np.minimum(result[many[ok], k], mine[ok, place[ok]])
    return result


def _by_suffixes(body: np.ndarray, begin: np.ndarray, length: np.ndarray, ids: np.ndarray, sizes: Shape) -> np.ndarray:
    """For each text and each of its strings, the least id among the texts that hold the string; by their common suffix array.

    Bytes are raised by one, so that a zero closes a text; UTF-8 never holds the highest byte.
    """
    inside = (np.arange(body.shape[1]) >= begin[:, None]) & (np.arange(body.shape[1]) < (begin + length)[:, None])
    ends = np.cumsum(length + 1)
    starts = ends - length - 1
    symbols = np.zeros(int(ends[-1]), np.uint8)
    where = np.ones(len(symbols), bool)
    where[ends - 1] = False
    symbols[where] = body[inside] + np.uint8(1)
    order = suffix_array(symbols.tobytes())
    owner = np.repeat(np.arange(len(length)), length + 1)[order]
    place = order - starts[owner]
    whole = place + sizes.least <= length[owner]
    order, owner, place = order[whole], owner[whole], place[whole]
    # neighbours are equal if all of their words are; the last word overlaps the one before
    eight = eights(symbols)
    new = np.zeros(len(order), bool)
    new[0] = True
    for step in [*range(0, sizes.least - 7, 8), sizes.least - 8]:
        word = eight[order + step]
        new[1:] |= word[1:] != word[:-1]
    at = np.flatnonzero(new)
    low = np.minimum.reduceat(ids[owner], at)[np.cumsum(new) - 1]
    out = np.full((len(length), sizes.strings), NO_ID)
    out[owner, place] = low
    return out


def _masks(sizes: Shape) -> Callable[[pa.Table], pa.Table]:
    def masks(bucket: pa.Table) -> pa.Table:
        """Per part: for each of its stretches the strings that an id below its own least one has."""
        spread = zstandard.ZstdDecompressor().decompress
        blobs = [spread(x) for x in bucket["words"].to_pylist()]
        words = np.frombuffer(b"".join(blobs), "<u8").reshape(-1, sizes.row // 8)
        ids = _joined(bucket["ids"], "<i8")
        every = unique(words, ids, sizes)
        lower = least_ids(every.words, every.key, every.least, sizes)
        out = []
        at = 0
        for blob in blobs:
            n = len(blob) // sizes.row
            out.append(np.packbits(lower[every.number[at : at + n]] < ids[at : at + n, None], axis=1).tobytes())
            at += n
        return pa.table({"part": bucket["part"], "bucket": bucket["bucket"], "mask": pa.array(out, pa.binary())})

    return masks


# 4. removal


def _spans(flags: np.ndarray) -> np.ndarray:
    """The runs of set flags, as pairs of start and end."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edges.reshape(-1, 2)


def _removal(sizes: Shape, carries: bool, whole: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def removal(docs: pa.Table, notes: pa.Table) -> pa.Table:
        ids, texts = _texts(docs)
        told = notes.filter(pc.is_valid(notes["mask"])).sort_by("bucket")
        found = stretches(texts, *_known(notes.filter(pc.is_valid(notes["keys"]))), sizes)
        mine = unique(found.words, ids[found.row], sizes)
        packed = _joined(told["mask"], "u1").reshape(len(mine.key), -(-sizes.strings // 8))
        cuts = np.searchsorted(found.row, np.arange(len(texts) + 1)).tolist()
        across = np.arange(sizes.strings)
        out = {"id": docs["id"], "n_bytes": [], "spans": [], "kept": []}
        for k, text in enumerate(docs["text"].to_pylist()):
            text = text or b""
            spans = np.zeros((0, 2), np.int64)
            if cuts[k] < cuts[k + 1]:
                own = slice(cuts[k], cuts[k + 1])
                gone = np.unpackbits(packed[mine.number[own]], axis=1, count=sizes.strings).astype(bool)
                gone |= (mine.least[mine.number[own]] < ids[k])[:, None]
                gone &= across < found.count[own, None]
                start = (found.start[own, None] + across)[gone]
                turn = np.bincount(start, minlength=len(text) + 1)
                turn -= np.bincount(start + sizes.least, minlength=len(text) + 1)
                spans = _spans(np.cumsum(turn[:-1]) > 0)
            borders = [0, *spans.ravel().tolist(), len(text)]
            out["n_bytes"].append(len(text))
            out["spans"].append([{"start": a, "end": b} for a, b in spans.tolist()])
            kept = b"".join([text[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True)])
            out["kept"].append(kept.decode(errors="ignore").encode() if whole else kept)
        return pa.table(({"rest": docs["rest"]} if carries else {}) | {
            "id": out["id"], "n_bytes": pa.array(out["n_bytes"], pa.int64()), "kept": pa.array(out["kept"], pa.binary()),
            "spans": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return removal


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST, carried: Sequence[str] = (), part_bytes: int = PART_BYTES, hot: int = HOT, whole: bool = False) -> DataFrame:
    """``(id, n_bytes, kept, spans)`` for every row: the bytes of its text that stay, and the spans ``(start, end)`` of those that go.

    A byte goes if one of the strings of ``least`` bytes that cover it also
    starts in a row with a smaller id. Matches never cross rows, and are judged on
    the texts as given. A null text is an empty one. Rows with one id do not
    lend to each other, however often they occur; a row with a null id lends to
    none and loses nothing. The id comes under the name of ``id_col``. An empty
    table gives an empty table. ``carried`` names columns to take along; they may
    be called as they like, as they come as the fields of a struct ``rest``.
    With ``whole`` what is left of a character that a cut has split is not kept.

    ``part_bytes`` and ``hot`` bound what a task holds, and change no result.
    """
    sizes = shape(least)
    total = docs.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0
    parts = int(total // part_bytes) + 1
    key = F.xxhash64(col(id_col).cast("long"), col(text_col))
    rest = [F.struct(*map(col, carried)).alias("rest")] if carried else []
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("binary").alias("text"), F.pmod(key, F.lit(parts)).alias("part"), *rest)
    found = rows.where("id IS NOT NULL").select("part", "text").mapInArrow(_anchors(parts, sizes), "bucket long, part long, keys binary, notes binary")
    known = found.groupBy("bucket").applyInArrow(_shared(hot), "part long, keys binary, hot binary")
    sent = rows.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_stretches(parts, sizes), "bucket long, part long, words binary, ids binary")
    masks = sent.groupBy("bucket").applyInArrow(_masks(sizes), "part long, bucket long, mask binary")
    none = lambda *names: [F.lit(None).cast(kind).alias(name) for name, kind in names]
    notes = known.select("part", "keys", "hot", *none(("bucket", "long"), ("mask", "binary")))
    notes = notes.unionByName(masks.select("part", *none(("keys", "binary"), ("hot", "binary")), "bucket", "mask"))
    kinds = T.StructType(list(rows.select(*(["rest"] if carried else [])).schema) + list(T.StructType.fromDDL("id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")))
    done = rows.groupBy("part").cogroup(notes.groupBy("part")).applyInArrow(_removal(sizes, bool(carried), whole), kinds)
    return done.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """``docs`` with what ``remove_repeats`` keeps of each text, in the same columns; characters that a cut has split go whole, and a null text becomes an empty one."""

    done = remove_repeats(docs, id_col, text_col, least, carried=[c for c in docs.columns if c != text_col], whole=True)
    field = lambda name: F.col(f"rest.{quoted(name)}")
    return done.select(*(F.col("kept").cast("string").alias(c) if c == text_col else field(c) for c in docs.columns))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of all documents when repeated strings of 50 bytes go."""
    done = remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", LEAST)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
