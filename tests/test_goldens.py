"""The golden cases: text, changed flag, records and spans."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from inkveil.operators.names import redact_names
from inkveil.operators.policy import redact_with_policy
from inkveil.operators.redact import redact, scan
from inkveil.sources.policies import Policy, policy_table

CASES = [json.loads(line) for line in (Path(__file__).parent / "goldens.jsonl").open()]


def policy_of(spec: dict) -> Policy:
    lists = dict(
        custom_names=tuple(spec.get("names", ())), allowlist_tokens=tuple(spec.get("allow", ()))
    )
    return Policy.only(spec["only"], **lists) if "only" in spec else Policy(**lists)


@pytest.fixture(scope="module")
def outcomes(spark):
    by_policy: dict[str, list] = {}
    for case in CASES:
        by_policy.setdefault(json.dumps(case["policy"], sort_keys=True), []).append(case)
    found = {}
    for spec, cases in by_policy.items():
        df = spark.createDataFrame([(c["id"], c["text"]) for c in cases], "id string, text string")
        for row in redact(df, "text", policy_of(json.loads(spec))).collect():
            found[row["id"]] = row
    return found


def test_there_are_52_cases():
    assert len(CASES) == 52


@pytest.mark.parametrize("case", CASES, ids=lambda c: c["id"])
def test_golden(outcomes, case):
    row = outcomes[case["id"]]
    assert row["redacted_text"] == case["redacted"]
    assert row["changed"] == case["changed"]
    assert [[m["entity"], m["start"], m["end"]] for m in row["matches"]] == case["matches"]
    assert [m["seq"] for m in row["matches"]] == list(range(len(case["matches"])))
    assert row["n_matches"] == len(case["matches"])


def test_null_text(spark):
    df = spark.createDataFrame([(1, None), (2, "a@b.com")], "id int, text string")
    kept = {r["id"]: r for r in scan(df).collect()}
    assert kept[1]["redacted_text"] is None
    assert kept[1]["changed"] is None
    assert kept[1]["matches"] is None
    assert kept[1]["n_matches"] is None
    assert kept[2]["n_matches"] == 1
    assert [r["id"] for r in redact(df).collect()] == [2]


def test_all_rules_off_changes_nothing(spark):
    df = spark.createDataFrame([(c["id"], c["text"]) for c in CASES], "id string, text string")
    rows = scan(df, "text", Policy.only([])).collect()
    assert all(r["redacted_text"] == r["text"] and r["n_matches"] == 0 for r in rows)


def test_disabled_policy_lets_nothing_through(spark):
    df = spark.createDataFrame([(1, "a@b.com")], "id int, text string")
    assert redact(df, "text", Policy(enabled=False)).count() == 0


def test_custom_names_run_with_the_name_rules_off(spark):
    df = spark.createDataFrame([(1, "Dear Alice, ask Bob.")], "id int, text string")
    policy = Policy.without("name", custom_names=("Bob",))
    row = redact(df, "text", policy).first()
    assert row["redacted_text"] == "Dear Alice, ask XXX."
    assert [(m["pass"], m["entity"], m["start"], m["end"]) for m in row["matches"]] == [
        (17, "name", 16, 19)
    ]


@pytest.mark.parametrize(
    "names, expected",
    [
        (("Ann", "Ann Lee"), ("met XXX Lee", [17])),
        (("Ann Lee", "Ann"), ("met XXXXXXX", [17])),
        (("Ann", "XXX Lee"), ("met XXXXXXX", [17, 18])),
        ((" ", "　", " Ann\n"), ("met XXX Lee", [17])),
        (("a.n", "Lee"), ("met Ann XXX", [18])),
        (("ann",), ("met Ann Lee", [])),
    ],
)
def test_names_run_in_list_order(spark, names, expected):
    df = spark.createDataFrame([(1, "met Ann Lee")], "id int, text string")
    row = redact(df, "text", Policy(custom_names=names)).first()
    assert (row["redacted_text"], [m["pass"] for m in row["matches"]]) == expected


def test_name_with_pattern_characters(spark):
    df = spark.createDataFrame(
        [(1, r"a \E.b c"), (2, "x@foo y"), (3, "(Bob)")], "id int, text string"
    )
    policy = Policy.only([], custom_names=(r"a \E.b", "@foo", "(Bob)"))
    got = {r["id"]: r["redacted_text"] for r in redact(df, "text", policy).collect()}
    assert got == {1: "XXXXXX c", 2: "xXXXX y", 3: "(Bob)"}


@pytest.mark.parametrize(
    "tokens, expected",
    [
        (("",), "card XXXX"),
        (("", "Acme"), "card Acme"),
        (("No", "Acme"), "card NoNo"),
        (("XX",), "card XXXX"),
    ],
)
def test_allowlist_restores_by_length(spark, tokens, expected):
    df = spark.createDataFrame([(1, "card Bond")], "id int, text string")
    policy = Policy(custom_names=("Bond",), allowlist_tokens=tokens)
    row = redact(df, "text", policy).first()
    assert row["redacted_text"] == expected
    assert row["n_matches"] == 1


def test_long_clean_text(spark):
    text = "lorem ipsum dolor sit amet " * 1000
    row = redact(spark.createDataFrame([(text,)], "text string")).first()
    assert row["redacted_text"] == text and not row["changed"] and row["n_matches"] == 0


def test_many_matches_in_one_text(spark):
    n = 100_000
    text = "mail a@b.com, " * n
    row = redact(spark.createDataFrame([(text,)], "text string")).first()
    assert row["n_matches"] == n
    assert [(m["start"], m["end"]) for m in row["matches"]] == [
        (14 * i + 5, 14 * i + 12) for i in range(n)
    ]


def test_setting_that_breaks_the_patterns_is_refused(spark):
    df = spark.createDataFrame([("a@b.com",)], "text string")
    spark.conf.set("spark.sql.parser.escapedStringLiterals", "true")
    try:
        with pytest.raises(ValueError):
            redact(df)
    finally:
        spark.conf.unset("spark.sql.parser.escapedStringLiterals")


def test_column_names_with_dots_and_blanks(spark):
    names = spark.createDataFrame([(1, "Bob")], "ord int, name string")
    df = spark.createDataFrame([(1, "a", "Bob, a@b.com")], "`a.b` int, `my scope` string, `the text` string")
    policies = policy_table(spark, {"a": Policy.only("email", custom_names=("Bob",))})
    for out in (
        redact(df, "the text", Policy(custom_names=("Bob",))),
        redact_names(df, names, "the text", small=0),
        redact_with_policy(df, policies, "my scope", "the text"),
    ):
        assert out.columns[:3] == ["a.b", "my scope", "redacted_text"]
        assert tuple(out.first())[:4] == (1, "a", "XXX, XXX@b.com", True)
