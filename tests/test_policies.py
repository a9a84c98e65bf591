"""Policies: sources, defaults, and the join with the texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkveil.functions.rules import ENTITIES, TOGGLES
from inkveil.operators.policy import redact_with_policy
from inkveil.sources.policies import (
    SWITCHES, Policy, policy_from_toml, policy_table, read_policies, with_defaults,
)
from inkveil.sources.tables import new_folder
from tests import model

PARTIAL = """
enabled = false
clipboard_retry_count = 3

[hotkey]
key = "R"

[redaction]
redact_email = false
custom_names = ["Alice", "Bob"]
"""


def test_default_policy():
    policy = Policy()
    assert policy.enabled and all(policy.switches().values()) and len(SWITCHES) == 12
    assert policy.custom_names == () and policy.allowlist_tokens == ()


def test_toml_partial_section_takes_defaults():
    policy = policy_from_toml(PARTIAL)
    assert not policy.enabled
    assert [s for s, on in policy.switches().items() if not on] == ["redact_email"]
    assert policy.custom_names == ("Alice", "Bob") and policy.allowlist_tokens == ()


@pytest.mark.parametrize("text", ["", "enabled = true", "enabled = 1\n[redaction]", "[redaction]",
                                  "enabled = true\n[redaction]\nredact_email = 'no'",
                                  "enabled = true\n[redaction]\ncustom_names = [1]"])
def test_toml_errors(text):
    with pytest.raises(ValueError):
        policy_from_toml(text)


@pytest.mark.parametrize("value", ['"Bob"', "true", "[1]"])
def test_toml_lists_are_lists(value):
    with pytest.raises(ValueError):
        policy_from_toml(f"enabled = true\n[redaction]\ncustom_names = {value}\n")


@pytest.mark.parametrize("bad", [
    '{"scope": "a", "enabled": "false"}', '{"scope": "a", "redact_email": "no"}', '{"scope": "a", ', '{"enabled": false}',
    '{\n  "scope": "a",\n  "enabled": false\n}', '{"scope": "a", "custom_names": "Bob"}',
])
def test_bad_policies_fail(spark, bad):
    path = new_folder(spark)
    spark.createDataFrame([(bad,)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception, match="MALFORMED|no scope|FAILED_READ"):
        read_policies(spark, path).collect()


def test_policies_over_several_lines(spark):
    path = new_folder(spark)
    spark.createDataFrame([('{\n  "scope": "a",\n  "enabled": false\n}',)], "value string").coalesce(1).write.text(path)
    assert [(r["scope"], r["enabled"]) for r in read_policies(spark, path, multiLine=True).collect()] == [("a", False)]


def test_missing_source_gives_the_default(spark):
    path = new_folder(spark)
    want = with_defaults(policy_table(spark, {"default": Policy()})).collect()
    assert read_policies(spark, path).collect() == want
    assert read_policies(spark, path, create=True).collect() == want
    # Now it is there.
    assert spark.read.json(path).count() == 1
    assert read_policies(spark, path).collect() == want


def test_partial_rows_take_defaults(spark):
    path = new_folder(spark)
    spark.createDataFrame([('{"scope": "a", "redact_email": false, "other": 1}',),
                           ('{"scope": "b", "enabled": false}',)], "value string").write.text(path)
    got = {r["scope"]: r for r in read_policies(spark, path).collect()}
    assert not got["a"]["redact_email"] and got["a"]["redact_phone"] and got["a"]["enabled"]
    assert not got["b"]["enabled"] and got["b"]["custom_names"] == []


def test_other_formats(spark):
    path = new_folder(spark)
    table = policy_table(spark, {"a": Policy.only("email"), "b": Policy(custom_names=("Bob",))})
    table.write.parquet(path)
    assert read_policies(spark, path, "parquet").orderBy("scope").collect() == table.orderBy("scope").collect()


SCOPED = {
    "all": Policy(),
    "none": Policy.only([]),
    "off": Policy(enabled=False),
    "names": Policy.without(["name", "email"], custom_names=("Bob", " ", "Alice Smith")),
    "tokens": Policy(custom_names=("Bob",), allowlist_tokens=("", "Tim", "Acme")),
    "phones": Policy.only(["phone", "ip_address"]),
}


@pytest.mark.parametrize("limit", [1 << 20, 1], ids=["broadcast", "salted"])
def test_each_row_follows_its_policy(spark, limit):
    rng = random.Random(3)
    # A third of the rows share one scope; some have none.
    scopes = [*SCOPED, "unknown", None] + ["all"] * 4
    rows = [(i, rng.choice(scopes), model.random_text(rng)) for i in range(900)]
    rows += [(900, "all", None), (901, "off", "a@b.com")]
    df = spark.createDataFrame(rows, "id long, scope string, text string").repartition(8)
    got = {
        r["id"]: r
        for r in redact_with_policy(df, policy_table(spark, SCOPED), "scope", limit=limit).collect()
    }
    want_ids = {i for i, scope, text in rows if text is not None and scope != "off"}
    assert set(got) == want_ids
    for i, scope, text in rows:
        if i not in got:
            continue
        policy = SCOPED.get(scope, Policy())
        on = {e for e in ENTITIES if policy.switches()[TOGGLES[e]]}
        want, found = model.redact(text, on, policy.custom_names, policy.allowlist_tokens)
        row = got[i]
        assert row["redacted_text"] == want, (scope, text)
        assert [(m["pass"], m["entity"], m["start"], m["end"]) for m in row["matches"]] == found


def test_two_policies_for_one_scope(spark):
    df = spark.createDataFrame([("a", "x")], "scope string, text string")
    table = policy_table(spark, {"a": Policy()})
    with pytest.raises(ValueError):
        redact_with_policy(df, table.unionByName(table), "scope")


def test_small_policy_tables_are_broadcast_and_large_ones_are_not(spark):
    df = spark.range(10).select(F.concat(F.lit("s"), "id").alias("scope"), F.lit("x").alias("text"))
    table = policy_table(spark, {"a": Policy()})

    def plan(limit):
        return redact_with_policy(df, table, "scope", limit=limit)._jdf.queryExecution().toString()

    assert "BroadcastHashJoin" in plan(1 << 20)
    assert "SortMergeJoin" in plan(1) and "BroadcastHashJoin" not in plan(1)
