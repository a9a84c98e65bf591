"""Tokens that are never masked."""

from __future__ import annotations

import random

import pytest

from inkveil.operators.names import redact_names
from inkveil.operators.policy import redact_with_policy
from inkveil.operators.redact import findings, redact
from inkveil.plans.reports import entity_report
from inkveil.sources.policies import Policy, policy_from_toml, policy_table


def test_what_equals_a_token_stays(spark):
    text = "Dear Alice Keller, mail help@shop.org or bob@shop.org, call 555-123-4567 or 555-123-4568"
    df = spark.createDataFrame([(text,)], "text string")
    policy = Policy(protected_tokens=("Alice Keller", "555-123-4567"))
    got = redact(df, "text", policy).first()
    plain = redact(df).first()
    assert got["redacted_text"] == "Dear Alice Keller, mail XXXX@shop.org or XXX@shop.org, call 555-123-4567 or XXX-XXX-XXXX"
    assert (got["n_matches"], plain["n_matches"]) == (3, 5)
    assert got["entity_counts"] == {"email": 2, "phone": 1}
    assert [m["seq"] for m in got["matches"]] == [0, 1, 2]
    phone = got["matches"][2]
    assert text.encode()[phone["start"] : phone["end"]] == b"555-123-4568"


def test_a_part_of_a_match_is_not_protected(spark):
    df = spark.createDataFrame([("Dear Alice Keller, 555-123-4567",)], "text string")
    got = redact(df, "text", Policy(protected_tokens=("Alice", "123", "", "'", "\\"))).first()
    assert got["redacted_text"] == "Dear XXXXXXXXXXXX, XXX-XXX-XXXX"


def test_names_and_spans_against_a_run_without(spark):
    """Names that are protected might as well not be in the list, but for the numbers of the passes."""
    rng = random.Random(5)
    words = ["Ada", "Bob", "Eve", "é", "a@b.org", "555-123-4567", ",", "XXX", "and"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(15)))) for k in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    some = redact(df, "text", Policy(custom_names=("Ada", "Eve"), protected_tokens=("Bob",)))
    more = redact(df, "text", Policy(custom_names=("Ada", "Bob", "Eve"), protected_tokens=("Bob",)))
    none = redact(df, "text", Policy(custom_names=("Ada", "Eve")))
    keyed = lambda x: sorted(map(tuple, x.select("id", "redacted_text", "n_matches", "changed").collect()))
    assert keyed(some) == keyed(more) == keyed(none)
    spans = lambda x: sorted(map(tuple, findings(x, "id").select("id", "seq", "entity", "start", "end").collect()))
    assert spans(some) == spans(more) == spans(none)
    names = spark.createDataFrame([(1, "Ada"), (2, "Bob"), (3, "Eve")], "ord int, name string")
    for lookup in (0, 1 << 20):
        table = redact_names(df, names, policy=Policy(protected_tokens=("Bob",)), lookup=lookup)
        assert spans(table) == spans(more)
    assert sorted(map(tuple, entity_report(more).collect())) == sorted(map(tuple, entity_report(none).collect()))


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["broadcast", "salted"])
def test_by_scope(spark, limit):
    df = spark.createDataFrame([("a", "mail x@y.org, call 555-123-4567"), ("b", "call 555-123-4567"), (None, "call 555-123-4567")], "scope string, text string")
    table = policy_table(spark, {"a": Policy(protected_tokens=("555-123-4567",)), "b": Policy()})
    got = redact_with_policy(df, table, "scope", limit=limit).select("scope", "redacted_text", "n_matches").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", "mail XXX@y.org, call 555-123-4567", 1), ("b", "call XXX-XXX-XXXX", 1), (None, "call XXX-XXX-XXXX", 1)], key=repr)


def test_from_settings():
    policy = policy_from_toml('enabled = true\n[redaction]\nprotected_tokens = ["Acme"]')
    assert policy.protected_tokens == ("Acme",)


def test_short_and_long_lists_of_names_agree(spark, monkeypatch):
    """A short list is a pass for each name, a long one a fold over the list."""
    names = ("Ann", " Bob ", "", "a.b", r"x\Ey", "it's", "X", "XXX Lee", "Zoë　", "\\", "'")
    rows = [(k, x) for k, x in enumerate(["Ann Lee met Bob", "a.b aXb", r"see x\Ey now", "it's X and XXX Lee", "Zoë, Zoe", "back \\ slash ' quote", None, "", "Ann\nAnn Ann"])]
    df = spark.createDataFrame(rows, "id int, text string")
    policy = Policy(custom_names=names, protected_tokens=("Bob",))
    by_pass = sorted(map(str, redact(df, "text", policy).collect()))
    monkeypatch.setattr("inkveil.operators.passes.FEW_NAMES", 0)
    assert sorted(map(str, redact(df, "text", policy).collect())) == by_pass
