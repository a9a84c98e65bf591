"""Rules of the caller: compiled patterns match what the plain ones match, and unsafe ones are refused."""

from __future__ import annotations

import random
import re
import time

import pytest

from inkveil.functions.own_rules import UnsafePattern, compiled, own_rule
from inkveil.operators.policy import redact_with_policy
from inkveil.operators.redact import redact
from inkveil.plans.reports import rule_counters
from inkveil.sources.policies import Policy, policy_table, read_policies

SAFE = [
    r"EMP-[0-9]{4,8}", r"\bEMP-\d+", r"\b\w+@\d{2}", r"=\s*[a-f]{2,4}x", r"#[^#\s]+#", r"(?:ab|cd){1,5}e", r"\b[A-Z]\w{0,20}\d\b",
    r"it's\x20\d", r"[']\w{1,3}[']", r"(?<![0-9])[0-9]+-", r"\$[0-9]+(?:\.[0-9]{2})?", r"a|b\d+", r"x{3}", r"\bé+\d", r"(?:a|#)\d+", r"(ab|c)\s*x", r"[^a-z]{2,3}a", r"(?=\d)\d{2}\b",
]
UNSAFE = [
    r"(a+)+b", r"\w+@", r"a*a*b", r"\b\w+\d", r".*x", r"x.*?y", r"(\w|\d)*x", r"(?:a{1,100}){1,100}b", r"[0-9]+", r"\d{1,64}\d{1,64}\d{1,64}x",
    r"(a)\1", r"\p{L}", r"a*", r"", r"x?", r"(?i)a", r"[a", r"(a", r"a)", r"a**", r"[a&&b]", r"\b", r"a{2", r"(?=a*b)c", r"(?:x\w+){1,3}y", r"\w{1,2000}x", r"é+\d", r"\b[A-Z]\w*\d\b", r"(?:a|1)\d+",
]


@pytest.mark.parametrize("pattern", UNSAFE)
def test_refused(pattern):
    with pytest.raises(UnsafePattern):
        compiled(pattern)


def test_same_matches(spark):
    """Python's engine runs the pattern as given; the text and the spans must be the same."""
    rng = random.Random(3)
    parts = ["EMP-", "123", "4", "ab", "cd", "e", "@", "#", "=", " ", "  ", "\n", "'", "it's ", "$", ".", "-", "x", "xxx", "é", "É", "A", "a", "_", "东"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4).cache()
    for pattern in SAFE:
        rule = own_rule("thing", pattern, "alphanumeric")
        off = Policy.only([])
        got = {r["id"]: r for r in redact(df, "text", off, (rule,)).collect()}
        for k, text in enumerate(texts):
            want = [(len(text[: m.start()].encode()), len(text[: m.end()].encode())) for m in re.finditer(pattern, text)]
            assert [(m["start"], m["end"]) for m in got[k]["matches"]] == want, (pattern, text)
            masked = re.sub(pattern, lambda m: "".join("X" if c.isalnum() else c for c in m[0]), text)
            assert got[k]["redacted_text"] == masked, (pattern, text)


def test_case(spark):
    df = spark.createDataFrame([("Badge 12, BADGE 7, bädge 1, BÄDGE 2, [q]5 [Q]6 r7",)], "text string")
    one = own_rule("badge", r"badge \d+", "account_like", ignore_case=True)
    two = own_rule("badge", r"bädge \d+", "account_like", ignore_case=True, name="second")
    three = own_rule("badge", r"[p-q]\]\d", "account_like", ignore_case=True, name="third")
    got = redact(df, "text", None, (one, two, three)).first()
    assert got["redacted_text"] == "Badge XX, BADGE X, bädge X, BÄDGE X, [q]X [Q]X r7"


def test_hostile_texts_take_no_time(spark):
    """Twice the text, about twice the time: far from the square."""
    rules = tuple(own_rule("thing", p, name=f"p{k}") for k, p in enumerate(SAFE))
    for unit in ("a", "1", "=", " ", "# ", "ab", "é", "A1", "EMP-"):
        df = spark.createDataFrame([(unit * (400_000 // len(unit)),)], "text string")
        begun = time.time()
        redact(df, "text", Policy.only([]), rules).select("n_matches").collect()
        assert time.time() - begun < 20


def test_tail_only(spark):
    df = spark.createDataFrame([("ticket 12 and ticket 345",)], "text string")
    got = redact(df, "text", None, (own_rule("ticket", r"\b(ticket )(\d+)", "account_like", group=2),)).first()
    assert (got["redacted_text"], got["entity_counts"]) == ("ticket XX and ticket XXX", {"ticket": 2})
    for pattern in ("ticket ([0-9]{2})", "(a)(b)(c)", "(a)|(b)", "(a(b))(c)", "x(a)(b)"):
        with pytest.raises(ValueError):
            own_rule("ticket", pattern, group=2)


def test_order_and_numbers(spark):
    """Own rules run after the library's and before names; the text of a pass is what those before have left."""
    df = spark.createDataFrame([("mail a@b.com 77 Zoe",)], "text string")
    rules = (own_rule("host", r"@b\.com"), own_rule("pair", r"\b77 Zoe"))
    got = redact(df, "text", Policy(custom_names=("Zoe",)), rules).first()
    assert got["redacted_text"] == "mail XXXXXXX" + "X" * 2 + " XXXXXX" or got["redacted_text"] == "mail XXXXXXXXX XXXXXX"
    assert [(m["pass"], m["entity"]) for m in got["matches"]] == [(2, "email"), (17, "host"), (18, "pair")]
    got = redact(df, "text", Policy(custom_names=("Zoe",)), rules[:1]).first()
    assert [(m["pass"], m["entity"]) for m in got["matches"]] == [(2, "email"), (17, "host"), (18, "name")]


def test_switches(spark, tmp_path):
    rules = (own_rule("badge", r"B\d+"), own_rule("date", r"\bnoon\b"))
    rows = [("on", "B12 at noon"), ("off", "B12 at noon"), ("nodate", "B12 at noon"), ("other", "B12 at noon"), (None, "B12 at noon"), ("on", None)]
    df = spark.createDataFrame(rows, "scope string, text string")
    policies = {"on": Policy(), "off": Policy(off=frozenset({"redact_own_badge"})), "nodate": Policy.without("date")}
    want = [("on", "XXX at XXXX"), ("off", "B12 at XXXX"), ("nodate", "XXX at noon"), ("other", "XXX at XXXX"), (None, "XXX at XXXX")]
    policy_table(spark, policies, rules).write.json(f"{tmp_path}/policies")
    for table in (policy_table(spark, policies, rules), read_policies(spark, f"{tmp_path}/policies", own=rules)):
        for limit in (1 << 20, 1):
            got = redact_with_policy(df, table, "scope", limit=limit, rules=rules)
            assert sorted(map(tuple, got.select("scope", "redacted_text").collect()), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        redact_with_policy(df, policy_table(spark, policies, rules), "scope")
    with pytest.raises(ValueError):
        redact(df, "text", Policy(off=frozenset({"redact_own_nothing"})), rules)
    with pytest.raises(ValueError):
        Policy(off=frozenset({"nothing"}))


def test_counters(spark):
    df = spark.createDataFrame([("B12 at noon, B3",), (None,), ("",)], "text string")
    rules = (own_rule("badge", r"B\d+"), own_rule("date", r"\bnoon\b"))
    counts = rule_counters(redact(df, "text", Policy(custom_names=("at",)), rules), rules).collect()
    assert sorted(map(tuple, counts)) == [("redact_dates", 1), ("redact_own_badge", 2)]


def test_bad_declarations():
    for wrong in (("Bad name", "x"), ("ok", "x", "no_mask"), ("ok", "x", "name", 1)):
        with pytest.raises(ValueError):
            own_rule(*wrong)
    with pytest.raises(ValueError):
        own_rule("ok", "x", needs=("'",))
