"""Conversation repair against a search over all edits, and the query against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

from pyspark.sql import functions as F

from inkveil.llm import turns

AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
TURN = {"": "user", "s": "user", "u": "assistant", "a": "user"}
GAP = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows: list[tuple[str, str, str]]) -> tuple[int, str, list[str]]:
    """The least cost, the least audit of that cost, and what it writes, by uniform-cost search; rows are (role, text, fault)."""
    heap = [(0, "", 0, "", [])]
    seen = set()
    while True:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (at, state) in seen:
            continue
        seen.add((at, state))
        heapq.heappush(heap, (cost + 3, audit + "I", at, TURN[state][0], [*out, TURN[state] + ":"]))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if role[:1] in AFTER[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], [*out, f"{role}:{text}"]))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, TURN[state][0], [*out, f"{TURN[state]}:{text}"]))


def report(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines of one conversation's (turn, role, text) in order."""
    faced, seen = [], set()
    for _, role, text in rows:
        last = GAP.findall(text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        faced.append((role, text, fault))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for r, _, _ in faced]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    cost, audit, out = cheapest(faced)
    faults = [f for _, _, f in faced]
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, out


def in_order(rows):
    def key(row):
        turn, role, text = row
        return turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()

    return sorted(rows, key=key)


def hurt(rows: list[tuple]) -> dict:
    """The rows of each conversation after damage."""
    out: dict = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kept = out.setdefault(conv, [])
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        kept += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return {c: in_order(x) for c, x in out.items()}


def conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(rng.randrange(1, 10)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown"])
            text = rng.choice(["Yes.", "No!", "What? ", "cut off", "\t \n", "", None, f"own {rng.random()}.", "naïve 東京", " "])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1]), role, text))
    rows += [rows[8], rows[8]]
    return rows + [(9999, k, "user" if k % 2 else "assistant", f"turn {k}" + ".?"[k % 3 % 2]) for k in range(700)]


NAMES = "conv_id long, turn long, role string, text string"


def test_lattice():
    rng = random.Random(2)
    faults = ["", "", "", "blank", "duplicate", "truncated"]
    for k in range(1500):
        n = rng.randrange(8) if k % 30 else rng.randrange(33, 150)
        rows = [(rng.choice("suauax") + "x", "", rng.choice(faults)) for _ in range(n)]
        codes = bytes({"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f] for _, _, f in rows)
        lattice = turns.Lattice("".join(r[0][0] for r in rows), codes)
        assert (lattice.cost, lattice.audit()) == cheapest(rows)[:2]


def test_query(spark, tmp_path):
    rows = conversations(1)
    df = spark.createDataFrame(rows, NAMES).withColumn("_conv", F.lit(1)).withColumn("audit", F.lit("x"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = turns.op13_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = []
    for conv, kept in hurt(rows).items():
        *counts, out = report(kept)
        want.append((conv, *counts, hashlib.sha256("\n".join(out).encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_repaired_rows(spark):
    rows = conversations(5)
    got: dict = {}
    for r in turns.repaired(spark.createDataFrame(rows, NAMES), "conv_id", "turn", "role", "text").collect():
        got.setdefault(r["conv_id"], []).append((r["seq"], r["edit"], f"{r['role']}:{r['text']}"))
    groups: dict = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, kept in groups.items():
        *_, audit, out = report(in_order(kept))
        mine = sorted(got.pop(conv, []))
        assert [x for _, _, x in mine] == out
        assert [x for _, x, _ in mine] == [x for x in audit if x != "D"]
        assert [k for k, _, _ in mine] == list(range(len(out)))
    assert not got


def test_empty(spark):
    empty = spark.createDataFrame([], NAMES)
    assert turns.repair_report(empty, "conv_id", "turn", "role", "text").count() == 0
    assert turns.repaired(empty, "conv_id", "turn", "role", "text").count() == 0
