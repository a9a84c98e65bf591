"""Secret scans with multipart credential linking.

Strong patterns stand by themselves. A weak candidate (a random-looking string,
an account name, an address of a service) is reported only where the parts of a
credential come together: the places of identifiers, each widened to a scope,
are interval-joined with the places of possible secrets and endpoints, which are
found whole, wherever they begin and end.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import col, table

#: Kinds in the order in which spans with one start are listed. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "identity", "key", "endpoint")
BASE = KINDS[:3]
#: Code points on either side of an identifier in which its counterparts may lie.
SCOPE = 300

# The patterns of the base kinds, with the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

IDENTITY = re.compile(r"""(?:access_?key_?id|client_?id|account_?(?:id|name)|user_?(?:id|name)|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", re.IGNORECASE | re.ASCII)
IDENTITY_WORDS = (b"key_id", b"keyid", b"client", b"account", b"user", b"login")
ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp|ssh)://[A-Za-z0-9._~:@%/?#&=+-]{3,}", re.ASCII)
KEY = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KEY_PARTS = tuple(map(re.compile, ("[a-z]", "[A-Z]", "[0-9]")))


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(text: str, low: bytes) -> list[Span]:
    spans = []
    if any(word in low for word in ASSIGN_WORDS):
        spans += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return spans + [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def scopes(spans: list[Span], reach: int, length: int) -> list[tuple[int, int]]:
    """The spans, widened by ``reach`` and merged where they meet."""
    merged: list[tuple[int, int]] = []
    for span in sorted(spans):
        low, high = max(0, span.start - reach), min(length, span.end + reach)
        if merged and low <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(high, merged[-1][1])
        else:
            merged.append((low, high))
    return merged


def near(span: Span, others: list[Span], reach: int) -> list[Span]:
    """Those of the sorted, disjoint others that lie within ``reach`` of the span."""
    at = bisect_left(others, span.start - reach, key=lambda x: x.end)
    found = []
    while at < len(others) and others[at].start <= span.end + reach:
        found.append(others[at])
        at += 1
    return found


def linked_spans(text: str, low: bytes, base: list[Span], reach: int) -> list[Span]:
    """The weak spans whose complementary parts lie in one scope.

    A possible key counts beside an access identifier, or beside a named
    identity if an endpoint is there too. The identities and endpoints that
    complete a key are reported with it.
    """
    strong = [x for x in base if x.kind == 1]
    named = [Span(m.start(), 3, m.end()) for m in IDENTITY.finditer(text)] if any(word in low for word in IDENTITY_WORDS) else []
    if not strong and not named:
        return []
    strong.sort()
    # base spans of several kinds may overlap, and disjoint ones are looked up
    taken, found = [Span(low, 0, high) for low, high in scopes(base, 0, len(text))], set()
    within = [Span(top, 0, bottom) for top, bottom in scopes(strong + named, reach, len(text))]
    ends = [Span(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    for m in KEY.finditer(text):
        key = Span(m.start(), 4, m.end())
        if not (here := near(key, within, 0)) or not all(part.search(m.group()) for part in KEY_PARTS):
            continue
        if any(x.start < key.end and key.start < x.end for x in near(key, taken, 0) + near(key, ends, 0)):
            continue
        owners, users = near(key, strong, reach), near(key, named, reach)
        places = [x for x in near(key, ends, reach) if near(x, here, 0)]
        if owners or users and places:
            found.add(key)
            found.update(users if places else ())
            found.update(places)
    return sorted(found)


def spans_of(text: str | None, reach: int = SCOPE) -> list[Span]:
    if not text:
        return []
    low = text.encode(errors="replace").lower()
    base = base_spans(text, low)
    return sorted(base + linked_spans(text, low, base, reach))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def with_secrets(df: DataFrame, text_col: str, out_col: str = "spans", reach: int = SCOPE) -> DataFrame:
    """``df`` with the array of a text's secrets ``(kind, start, end)`` by start and kind, in code points, ends exclusive.

    A null or empty text has none; every row is kept, each judged by itself, and
    a text of any length is searched whole. ``out_col`` replaces a column of
    that name; other columns are left as they are.
    """

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"kind": KINDS[x.kind], "start": x.start, "end": x.end} for x in spans_of(text, reach)] for text in texts.to_pylist()], kind)

    return df.withColumn(out_col, scan(col(text_col)))


def hidden(text: str, spans: list[Span], mark: str) -> str:
    """``text`` with ``mark`` in place of each run of spans that meet."""
    parts, at = [], 0
    for low, high in scopes(spans, 0, len(text)):
        parts += [text[at:low], mark]
        at = high
    return "".join(parts) + text[at:]


def masked(df: DataFrame, text_col: str, spans_col: str, mark: str = "[SECRET]") -> DataFrame:
    """The texts with each of their spans replaced by ``mark``; spans that overlap share one. Null texts stay null."""

    @F.arrow_udf("string")
    def mask(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([hidden(text, [Span(x["start"], 0, x["end"]) for x in found], mark) if text and found else text for text, found in rows], pa.string())

    return df.withColumn(text_col, mask(col(text_col), col(spans_col)))


def without_secrets(df: DataFrame, text_col: str, mark: str = "[SECRET]", reach: int = SCOPE) -> DataFrame:
    """``masked`` at the spans that ``with_secrets`` finds, in one pass over the texts; the same columns."""

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array([hidden(text, found, mark) if (found := spans_of(text, reach)) else text for text in texts.to_pylist()], pa.string())

    return df.withColumn(text_col, mask(col(text_col)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts and digest of the base kinds, and all spans."""
    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "found")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
