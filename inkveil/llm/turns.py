"""Repair of conversations by cheapest edits, found with an auction for shortest paths.

A conversation is a lattice: its nodes are (rows read, state of what was
written), its arcs the edits with their integer costs. The auction holds a path
from the start and a price for each node, never more than the cost of any arc
plus the price at its end. A path is extended along the arc that gives the
price of its last node; if no arc does, that price rises to the least of them
and the path is contracted by one arc. When the path reaches the end, the prices
along all cheapest paths differ by just the costs of their arcs: those arcs are
*tight*, and a walk over them in the order of letters spells the least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import col, settled, table

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: States: nothing written, a first system turn, a user's turn last, an assistant's turn last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that each initial leads to, and the turn that an insertion or a new role writes.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WRITES = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows of a lattice that are solved at once, from the last ones to the first.
STRETCH = 32
#: What counts as a character: all but blanks.
SEEN = r"[^\x20\x09-\x0D]"


class Lattice:
    """The edits of one conversation, given by its rows' initials and faults.

    Rows are solved in stretches from the last to the first. A stretch's auctions
    start at each state of its first row and end at the exact prices of the
    next stretch, so the work grows with the length of the conversation.
    """

    def __init__(self, initials: str, faults: bytes) -> None:
        self.initials, self.faults, self.rows = initials, faults, len(faults)
        self.price = [0] * (4 * self.rows + 4)
        self._solve(self.rows, self.rows)
        for end in range(self.rows, 0, -STRETCH):
            self._solve(max(end - STRETCH, 0), end)

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(letter, cost, node) of the edits at a node, by letter. No two have one letter."""
        row, state = divmod(node, 4)
        insert = ("I", INSERT, 4 * row + WRITES[state])
        if row == self.rows:
            return [insert]
        out, fault = [("D", DELETE, node + 4), insert], self.faults[row]
        if fault in (0, TRUNCATED):
            more = CUT_OFF if fault else 0
            after = NEXT[state].get(self.initials[row])
            if after is not None:
                out.append(("K", KEEP + more, 4 * row + 4 + after))
            out.append(("R", REROLE + more, 4 * row + 4 + WRITES[state]))
        return out

    def _ends(self, node: int) -> bool:
        return node >= 4 * self.rows and node % 4 in (START, ASSISTANT)

    def _solve(self, first: int, end: int) -> None:
        """Auctions from the four states of row ``first`` to the nodes of row ``end``, whose prices are exact; the last row ends where the lattice does."""
        price, arcs, last = self.price, self.arcs, first == self.rows
        # Prices begin as the least price of the end and the least cost of the rows before it: no arc costs less than its row's share.
        rest = min(price[4 * end : 4 * end + 4])
        for row in range(end - 1, first - 1, -1):
            rest += (0, DELETE, DELETE, CUT_OFF)[self.faults[row]]
            price[4 * row : 4 * row + 4] = [rest] * 4
        for origin in range(4 * first, 4 * first + 4):
            path = [origin]
            while True:
                node = path[-1]
                if self._ends(node) if last else node >= 4 * end:
                    break
                _, cost, after = min(arcs(node), key=lambda x: x[1] + price[x[2]])
                best = cost + price[after]
                if price[node] < best:
                    price[node] = best
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(after)

    @property
    def cost(self) -> int:
        return self.price[START]

    def audit(self) -> str:
        """The letters of the cheapest edits, the least of those in ASCII order: a walk over tight arcs that turns back at dead ends."""
        path, letters, dead, price = [START], [], set(), self.price
        while not (self._ends(path[-1]) and price[path[-1]] == 0):
            node = path[-1]
            step = next(((x, z) for x, y, z in self.arcs(node) if z not in dead and price[node] == y + price[z]), None)
            if step is None:
                dead.add(path.pop())
                letters.pop()
            else:
                letters.append(step[0])
                path.append(step[1])
        return "".join(letters)


def edits(audit: str, initials: str) -> Iterator[tuple[str, int, str | None]]:
    """(letter, row, new role) of an audit's letters; a kept or deleted row has no new role, an insertion's row is the next one."""
    row, state = 0, START
    for letter in audit:
        role = None
        if letter in "IR":
            state = WRITES[state]
            role = ROLES[state]
        elif letter == "K":
            state = NEXT[state][initials[row]]
        yield letter, row, role
        row += letter != "I"


def _faced(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows' columns under own names, with the digest that tells equal rows and the faults that a row shows by itself."""
    role_, text_ = F.coalesce(col(role).cast("string"), F.lit(" ")), F.coalesce(col(text).cast("string"), F.lit(" "))
    named = df.select(col(conv).alias("_conv"), col(turn).alias("_turn"), role_.alias("_role"), text_.alias("_text"))
    last = F.regexp_extract("_text", rf"({SEEN})[\x20\x09-\x0D]*\z", 1)
    return named.select(
        "_conv", "_turn", "_role", "_text",
        F.unhex(F.md5(F.concat(F.octet_length("_role").cast("string"), F.lit(":"), "_role", "_text"))).alias("_equal"),
        F.substring("_role", 1, 1).alias("_initial"),
        F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0).cast("tinyint").alias("_fault"),
    )


ORDER = ("_conv", "_kind", "_turn", "_equal")


def _dealt(df: DataFrame) -> DataFrame:
    """Whole conversations in a partition, their rows in order."""
    return df.repartition("_conv").sortWithinPartitions(*(F.col(x).asc_nulls_first() for x in ORDER if x in df.columns))


AUDITED = T.StructType([
    T.StructField("_conv", T.StringType()), T.StructField("_initials", T.StringType()), T.StructField("audit", T.StringType()),
    *(T.StructField(x, T.LongType()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
])


class _Rows:
    """What is held of a conversation while its rows pass: an initial and a fault for each one."""

    def __init__(self, conv: str | None) -> None:
        self.conv, self.initials, self.faults = conv, [], bytearray()
        self.low = self.high = self.turn = self.equal = None
        self.turns = 0

    def add(self, turn: int | None, equal: bytes, initial: str, fault: int, first: int | None) -> None:
        again = turn != first or (turn == self.turn and equal == self.equal)
        if turn is not None and (self.high is None or turn != self.high):
            self.turns += 1
            self.high = turn
            self.low = turn if self.low is None else self.low
        self.faults.append(DUPLICATE if again and fault != BLANK else fault)
        # A character of a role is at most one; none at all is told by one that no role may start.
        self.initials.append(initial or "\0")
        self.turn, self.equal = turn, equal

    def row(self) -> tuple:
        initials = "".join(self.initials)
        lattice = Lattice(initials, bytes(self.faults))
        illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))  # noqa: B905
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        count = self.faults.count
        return self.conv, initials, lattice.audit(), gaps, count(BLANK), count(DUPLICATE), count(TRUNCATED), illegal, lattice.cost


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: _Rows | None = None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        kinds = [pa.string()] * 3 + [pa.int64()] * 6
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], AUDITED.names)

    for batch in batches:
        for conv, turn, equal, initial, fault, first in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held is None or conv != held.conv:
                if held is not None:
                    done.append(held.row())
                held = _Rows(conv)
            held.add(turn, equal, initial, fault, first)
        if len(done) >= 1000:
            yield out()
            done.clear()
    if held is not None:
        done.append(held.row())
    if done:
        yield out()


def audits(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row for each conversation: ``_conv`` (as a string), its rows' initials, ``audit``, the counts of faults, and ``cost``.

    A row is a duplicate if the same role and text stand earlier, which the least turn of equal rows
    tells: that is a grouping of digests, summed up before it is shuffled. No text travels. A
    conversation's rows pass through one task in order; it holds some ten bytes for each.
    """
    rows = _faced(df, conv, turn, role, text).withColumn("_conv", F.col("_conv").cast("string")).drop("_role", "_text")
    # nulls stand before all turns, so a group that has one begins there
    first = rows.groupBy("_conv", "_equal").agg(F.min("_turn").alias("_least"), F.max(F.col("_turn").isNull()).alias("_none"))
    first = first.select(F.col("_conv").alias("_c"), F.col("_equal").alias("_e"), F.when(~F.col("_none"), F.col("_least")).alias("_first"))
    joined = rows.join(first, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_equal") == F.col("_e")))
    return _dealt(joined.select("_conv", "_turn", "_equal", "_initial", "_fault", "_first")).mapInArrow(_audits, AUDITED)


WRITTEN = "_conv string, _seq long, _letter string, _role string, _text string"


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The written rows of conversations whose rows follow their audits; each conversation ends with a row without letter."""
    steps: Iterator = iter(())
    ahead = None
    conv, seq, begun = None, 0, False

    def written() -> Iterator[tuple]:
        """Insertions that stand before the next row."""
        nonlocal ahead, seq
        while ahead is not None and ahead[0] == "I":
            yield conv, seq, "I", ahead[2], ""
            seq, ahead = seq + 1, next(steps, None)

    for batch in batches:
        out: list[tuple] = []
        for name, kind, _, _, audit, initials, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if kind == 0:
                if begun:
                    out += [*written(), (conv, seq, None, None, None)]
                conv, seq, begun, steps = name, 0, True, edits(audit, initials)
                ahead = next(steps, None)
                continue
            out += written()
            letter, _, new = ahead
            if letter != "D":
                out.append((conv, seq, letter, new or role, text))
                seq += 1
            ahead = next(steps, None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), *[pa.string()] * 3), strict=True)], ["_conv", "_seq", "_letter", "_role", "_text"])
    if begun:
        out = [*written(), (conv, seq, None, None, None)]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), *[pa.string()] * 3), strict=True)], ["_conv", "_seq", "_letter", "_role", "_text"])


def _written(df: DataFrame, conv: str, turn: str, role: str, text: str, found: DataFrame) -> DataFrame:
    """The repaired rows, conversation by conversation in each partition; each one's last row has no letter."""
    rows = _faced(df, conv, turn, role, text).select(
        F.col("_conv").cast("string").alias("_conv"), F.lit(1).alias("_kind"), "_turn", "_equal", F.lit(None).cast("string").alias("_audit"), F.lit(None).cast("string").alias("_initials"), "_role", "_text"
    )
    heads = found.select(
        "_conv", F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema["_turn"].dataType).alias("_turn"), F.lit(None).cast("binary").alias("_equal"), F.col("audit").alias("_audit"), "_initials",
        F.lit(None).cast("string").alias("_role"), F.lit(None).cast("string").alias("_text"),
    )
    return _dealt(heads.unionByName(rows)).mapInArrow(_repairs, WRITTEN)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = hashlib.sha256()
    for batch in batches:
        done: list[tuple] = []
        for conv, seq, letter, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if letter is None:
                done.append((conv, seq, state.hexdigest()))
                state = hashlib.sha256()
            else:
                state.update(f"{chr(10) if seq else ''}{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["_conv", "_length", "_sha"])


def repaired(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows of all repaired conversations: the conversation, ``seq`` from 0, ``edit`` (I, K or R), the role and the text.

    Rows are taken by turn, nulls first, those of one turn by a digest of role
    and text, so equal rows stand together. Null roles and texts count as one
    blank; rows without a conversation are one conversation; an empty table
    gives an empty one. Other columns do not matter, whatever their names.
    """
    rows = _written(df, conv, turn, role, text, settled(audits(df, conv, turn, role, text)))
    return rows.where(F.col("_letter").isNotNull()).select(
        F.col("_conv").cast(df.schema[conv].dataType).alias(conv), F.col("_seq").alias("seq"), F.col("_letter").alias("edit"), F.col("_role").alias(role), F.col("_text").alias(text)
    )


def repair_report(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row for each conversation that has rows: its faults, cost, audit, and the SHA-256 of its repaired ``role:text`` lines.

    Defined cases are those of ``repaired``. Texts are shuffled once and hashed as they
    pass: no task holds a conversation's texts.
    """
    found = settled(audits(df, conv, turn, role, text))
    sha = _written(df, conv, turn, role, text, found).mapInArrow(_digests, "_conv string, _length long, _sha string")
    sha = sha.select(F.col("_conv").alias("_c"), F.col("_sha").alias("repaired_sha256"))
    both = found.join(sha, F.col("_conv").eqNullSafe(F.col("_c")))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return both.select(F.col("_conv").cast(df.schema[conv].dataType).alias(conv), *counts, "audit", "repaired_sha256")


def damaged(df: DataFrame) -> DataFrame:
    """The conversations with the faults that the check of their repair asks for, by a checksum of conversation and turn; nulls become one blank."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = df.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_case"))
    rows = rows.where("_case <> 0").select(
        "conv_id", "turn", F.when(F.col("_case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_times"),
    )
    return rows.withColumn("_time", F.explode("_times")).drop("_times", "_time")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of all conversations after damage; those that lost all rows have zeros and no edit."""
    rows = table(spark, sf_dir, "conversations")
    report = repair_report(damaged(rows), "conv_id", "turn", "role", "text").withColumnRenamed("conv_id", "_id")
    whole = rows.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")

    def or_else(name: str, value: Column) -> Column:
        return F.coalesce(F.col(name), value).alias(name)

    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.select(
        "conv_id", *(or_else(x, F.lit(0).cast("long")) for x in counts), or_else("audit", F.lit("")), or_else("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))
    )
