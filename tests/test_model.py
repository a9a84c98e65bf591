"""Random texts: the library against brute force, and hints against patterns."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from inkveil.functions.expressions import raw
from inkveil.functions.patterns import NUMBERS
from inkveil.functions.rules import ENTITIES, RULES
from inkveil.operators.redact import redact
from inkveil.sources.policies import Policy
from tests import model

N = int(os.environ.get("FUZZ_TEXTS", "3000"))


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(int(os.environ.get("FUZZ_SEED", "7")))
    rows = [(i, model.random_text(rng)) for i in range(N)]
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(16).cache()


def compare(rows, df, policy, **options):
    got = {r["id"]: r for r in redact(df, "text", policy).collect()}
    for i, text in rows:
        want_text, want_found = model.redact(text, **options)
        row = got[i]
        found = [(m["pass"], m["entity"], m["start"], m["end"]) for m in row["matches"]]
        assert (row["redacted_text"], found) == (want_text, want_found), repr(text)
        assert row["changed"] == (want_text != text)
        assert row["n_matches"] == len(want_found) == sum(row["entity_counts"].values())


def test_all_rules(texts):
    compare(*texts, Policy())


@pytest.mark.parametrize("entity", ENTITIES)
def test_one_rule_alone(texts, entity):
    compare(*texts, Policy.only(entity), on={entity})


def test_lists(texts):
    names = ("Alice", "Bob", "Alice Smith", "José", "XXXXX Smith", "@x", "a.b", " Smith\n", "")
    tokens = ("Acme", "", "ab", "Alice")
    policy = Policy(custom_names=names, allowlist_tokens=tokens)
    compare(*texts, policy, names=names, tokens=tokens)


def test_each_rule_takes_part(texts):
    rows, _ = texts
    seen = {f[0] for _, text in rows for f in model.redact(text, None)[1]}
    assert seen == set(range(1, 17))


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.name)
def test_conditions_are_necessary(texts, rule):
    _, df = texts
    hit = df.filter(f"text RLIKE {raw(rule.pattern)}")
    missed = F.lit(False)
    if rule.shape:
        numbers = F.array_join(F.regexp_extract_all("text", F.lit(NUMBERS), F.lit(0)), "x")
        missed = missed | ~numbers.rlike(rule.shape)
    for literals in rule.needs:
        missed = missed | ~F.exists(
            F.array(*(F.lit(p) for p in literals)), lambda p: F.contains("text", p)
        )
    if rule.hint:
        missed = missed | ~F.expr(f"text RLIKE {raw(rule.hint)}")
    assert hit.count() > 0
    assert hit.filter(missed).collect() == []


def test_only_simple_case_folds(spark):
    # The dotless and the dotted Turkish i are no forms of "i"; the long s and
    # the Kelvin sign are forms of "s" and "k".
    rows = [(1, "p\u0131n: x"), (2, "P\u0130N: x"), (3, "pa\u017fs: x"), (4, "to\u212aen: x")]
    got = redact(spark.createDataFrame(rows, "id int, text string"))
    assert {r["id"]: r["n_matches"] for r in got.collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_text_that_holds_the_cut_mark(spark):
    rows = [(1, "a\ue000 x@y.org \ue000b@c.de, +1 771-322-0123\ue000"), (2, "\ue000")]
    df = spark.createDataFrame(rows, "id int, text string")
    compare(rows, df, Policy())


# rule: a text on which the plain pattern takes quadratic time or worse
WORST = {
    "sign_off": "best" + "\n" * 20_000,
    "passport": "passport" + " " * 20_000 + ".",
    "email": "a." * 60_000 + " x@y.org",
    "url_token": "http://a/" * 15_000 + " a=b",
    "labeled_field": "pin" + " " * 40_000 + "x:=" + " " * 40_000,
    "address": "1" + " " * 40_000 + "Oak",
    "salutation": "good" + " " * 40_000 + "Dear" + " " * 40_000 + "Al1",
    "account_like": "1 " * 40_000 + "é",
    "iban": "AB12" + "CDEF" * 20_000 + "_",
}


@pytest.mark.parametrize("rule", WORST)
def test_worst_texts(spark, rule):
    import time

    df = spark.createDataFrame([(WORST[rule],)], "text string")
    redact(df.limit(0)).collect()
    begun = time.time()
    redact(df).select("redacted_text", "n_matches").collect()
    assert time.time() - begun < 10
