"""Names from a table: the join must give what the passes one by one give."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from inkveil.operators.names import redact_names
from inkveil.operators.redact import redact
from inkveil.sources.policies import Policy
from tests import model

TRICKY = [
    "Alice", "Alice Smith", "Bob", "José", "X", "XX", "XXXXX", "XXXXX Smith", "Xavier", "Xavier Bob",
    "Smith Xavier", "@", "@x", "x@", "a.b", "-", ".", " Smith\n", "", "  ", "Jo", "x_1", "_",
    "thank you", "thank  you", "Oak Hill", "Hill\nOak", "AliceX", "aXXXXX", "12", "1", "a", "b", "é",
    "ß", "Bob, Alice", "Bob X Alice", "(Bob)", r"\E", "a\\Eb", "Smith Smith", "Alice - Bob", "X Bob",
]


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(11)
    words = ["Alice", "Bob", "Smith", "Xavier", "X", "José", "Oak", "Hill", "a", "b", "é", "x", "12",
             "@", "-", ".", ",", "_", "(", ")", "\n", " ", "  ", "thank", "you", r"\E", "", "Jo"]
    rows = []
    for i in range(1500):
        text = "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14)))
        rows.append((i, text))
    names = TRICKY[:]
    rng.shuffle(names)
    listed = list(enumerate(names, start=1))
    return (
        rows,
        spark.createDataFrame(rows, "id long, text string").repartition(8),
        listed,
        spark.createDataFrame(listed, "ord int, name string"),
    )


def expected(rows, listed):
    """The names keep the pass number of their ``ord``."""
    kept = [(o, n) for o, n in listed if n.strip()]
    out = {}
    for i, text in rows:
        want, found = model.redact(text, names=[n for _, n in kept])
        out[i] = want, [(p if p <= 16 else 16 + kept[p - 17][0], e, s, t) for p, e, s, t in found]
    return out


@pytest.mark.parametrize("small, limit, more", [
    (1000, 1, {}), (0, 1 << 20, {}), (0, 1, {}), (0, 1 << 20, {"lookup": 0}), (0, 1, {"lookup": 0}), (0, 1, {"lookup": 0, "key": "id"}),
], ids=["list", "broadcast", "salted", "joined", "joined salted", "joined by key"])
def test_names_table(cases, small, limit, more):
    rows, df, listed, names = cases
    want = expected(rows, listed)
    got = redact_names(df, names, small=small, limit=limit, **more).collect()
    assert len(got) == len(rows)
    for row in got:
        found = [(m["pass"], m["entity"], m["start"], m["end"]) for m in row["matches"]]
        assert (row["redacted_text"], found) == want[row["id"]], rows[row["id"]]


def test_repeated_and_missing_keys(spark):
    rows = [(1, "Alice"), (1, "Bob"), (None, "Bob"), (None, "clean"), (2, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    names = spark.createDataFrame([(1, "Alice"), (2, "Bob")], "ord int, name string")
    got = redact_names(df, names, small=0).select("id", "redacted_text").collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, [
        (1, "XXXXX"), (1, "XXX"), (None, "XXX"), (None, "clean"),
    ]))


def test_a_name_that_every_text_holds(spark):
    """One hot word must not be lost, nor multiply rows."""
    df = spark.range(3000).selectExpr("id", "concat('the word ', id, ' the end') AS text")
    names = spark.range(300).selectExpr(
        "cast(id AS int) AS ord", "if(id = 0, 'the', concat('n', id)) AS name"
    )
    got = redact_names(df, names, limit=1)
    assert got.count() == 3000
    assert got.filter("redacted_text = concat('XXX word ', id, ' XXX end') AND n_matches = 2").count() == 3000


def plan_of(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_no_text_is_moved(spark):
    """Few names: nothing is shuffled. Many names and a bucketed table: only keys and hashes are."""
    names = spark.range(500).selectExpr("id AS ord", "concat('Name', id) AS name")
    spark.range(2000).selectExpr("id", "concat('seen Name', id, ' and @ here') AS text").write.bucketBy(4, "id").mode("overwrite").saveAsTable("bucketed_texts")
    try:
        df = spark.table("bucketed_texts")
        few = redact_names(df, names)
        assert not [x for x in plan_of(few) if "Exchange" in x]
        many = redact_names(df, names, lookup=0, limit=1, key="id").filter("id IS NOT NULL")
        moved = [x for x in plan_of(many) if "Exchange" in x and "text" in x.split("Exchange")[1]]
        assert not moved
        # the join back reads the table in its buckets
        assert any("SortMergeJoin" in x and "__row" in x and "LeftOuter" in x for x in plan_of(many))
        want = sorted(map(tuple, few.select("id", "redacted_text").collect()))
        assert sorted(map(tuple, many.select("id", "redacted_text").collect())) == want
        assert sum("Name" not in x for _, x in want) == 500
    finally:
        spark.sql("DROP TABLE bucketed_texts")


def test_nothing_is_written(spark):
    """No text reaches the shared folder."""
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    df = spark.createDataFrame([("mail secret@b.org Bob",)], "text string")
    names = spark.createDataFrame([(1, "Bob")], "ord int, name string")
    before = sorted(root.rglob("*"))
    for lookup in (0, 1 << 20):
        assert redact_names(df, names, lookup=lookup).first()["redacted_text"] == "mail XXXXXX@b.org XXX"
    assert sorted(root.rglob("*")) == before


def test_large_and_missing_numbers(spark):
    """Numbers beyond an int keep their order; their pass number stays at the largest one."""
    df = spark.createDataFrame([("Ada Gray", None), ("Ada", 1)], "text string, k int")
    names = spark.createDataFrame([(3_000_000_000, "Ada"), (2_999_999_999, "Ada Gray"), (None, "Gray Ada"), (-5, "@")], "ord bigint, name string")
    got = []
    for more in ({}, {"lookup": 0}, {"lookup": 0, "key": "k"}):
        rows = redact_names(df, names, **more).collect()
        got.append(sorted((r["redacted_text"], [m["pass"] for m in r["matches"]]) for r in rows))
    assert got[0] == got[1] == got[2] == [("XXX", [2147483646]), ("XXXXXXXX", [2147483646])]


def test_name_of_punctuation_only(spark):
    """A name without a word piece belongs to every text, and a name table may hold nothing else, or nothing."""
    df = spark.createDataFrame([(1, "a ~~ b"), (2, "x~~"), (3, ""), (4, None)], "id int, text string")
    names = spark.createDataFrame([(2, "~"), (1, "b~")], "ord int, name string")
    plain = redact(df, "text", Policy(custom_names=("b~", "~"))).select("id", "redacted_text", "n_matches")
    for more in ({}, {"lookup": 0}):
        got = redact_names(df, names, **more).select("id", "redacted_text", "n_matches")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
        assert redact_names(df, names.filter("false"), **more).count() == 3
        assert redact_names(df.filter("false"), names, **more).count() == 0


def test_table_agrees_with_list(spark):
    df = spark.createDataFrame([(1, "Dear Alice, a@b.com met Bob")], "id int, text string")
    names = spark.createDataFrame([(1, "Bob"), (2, "met")], "ord int, name string")
    policy = Policy(off=frozenset({"redact_email"}), allowlist_tokens=("abc",))
    by_table = redact_names(df, names, policy=policy, small=0).collect()
    by_list = redact(
        df, "text", Policy(off=policy.off, custom_names=("Bob", "met"), allowlist_tokens=("abc",))
    ).collect()
    assert by_table == by_list


def test_few_and_many_names_give_the_same(spark):
    """Repeated names run once, and one without ord runs first, whatever the number of names."""
    df = spark.createDataFrame([(1, "XXXX met Ada Gray"), (2, None), (3, "")], "id long, text string")
    few = [(1, "XXXX"), (1, "XXXX"), (2, "Ada"), (None, "Ada Gray")]
    many = [*few, *((k, f"none{k}") for k in range(3, 400))]
    got = []
    for listed in (few, many):
        names = spark.createDataFrame(listed, "ord int, name string")
        done = redact_names(df, names).orderBy("id").collect()
        got.append([(r["id"], r["redacted_text"], [(m["pass"], m["start"]) for m in r["matches"]]) for r in done])
    assert got[0] == got[1]
    assert got[0][0] == (1, "XXXX met XXXXXXXX", got[0][0][2]) and len([x for x in got[0][0][2] if x[0] == 17]) == 1
