"""Reports, audits, streams and the plans behind them."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkveil.functions.rules import ENTITIES
from inkveil.operators.redact import findings, redact, restore_allowlist, scan
from inkveil.plans import audits, reports
from inkveil.sources.policies import Policy, policy_table
from inkveil.sources.tables import new_folder
from inkveil.streaming import jobs

LETTER = (
    "Hello Marta,\n\nthe plumber can come on Friday if you ring +44 20 7946 0958 before ten. He needs "
    "about an hour.\n\nKind regards,\nOtto Brandt"
)
ROWS = [
    (1, "a", LETTER), (2, "a", "x@y.org " * 12 + "Dear Bob"), (3, "b", "clean"), (4, "b", None),
    (5, None, "XXX@foo.org"), (6, "a", "10.1.12.100 and 192.168.1.100"),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, grp string, text string")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# (sf, table, text column): (changed, matches, by entity, texts with two or more entities)
CORPUS = {
    ("0.001", "documents", "text"): (
        13, 24, {"account_like": 7, "date": 1, "email": 5, "ip_address": 5, "phone": 6}, 5),
    ("0.001", "pages", "html"): (2, 2, {"ip_address": 2}, 0),
    ("0.01", "documents", "text"): (
        54, 106, {"account_like": 30, "date": 4, "email": 12, "ip_address": 28,
                  "labeled_field": 13, "phone": 19}, 27),
    ("0.01", "pages", "html"): (
        15, 30, {"account_like": 16, "email": 3, "ip_address": 4, "labeled_field": 3, "phone": 4}, 5),
    ("0.01", "conversations", "text"): (0, 0, {}, 0),
    ("0.01", "benchmark", "text"): (0, 0, {}, 0),
}


@pytest.mark.parametrize("sf, name, text", CORPUS)
def test_corpus_counts(spark, sf, name, text):
    table = spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet").select(text)
    rows = redact(table, text).drop("redacted_text", "matches").collect()
    by_entity: dict[str, int] = {}
    for row in rows:
        for entity, n in row["entity_counts"].items():
            by_entity[entity] = by_entity.get(entity, 0) + n
    assert (
        sum(r["changed"] for r in rows), sum(r["n_matches"] for r in rows), by_entity,
        sum(len(r["entity_counts"]) > 1 for r in rows),
    ) == CORPUS[sf, name, text]


def test_summaries(df):
    got = {r["id"]: r["summary"] for r in reports.summaries(redact(df), "id").collect()}
    assert got == {
        1: "Masked 3 item(s): 1 phone, 2 name",
        2: "Masked 13 item(s): 1 name, 12 email",
        3: reports.NOTHING_FOUND,
        5: reports.NOTHING_FOUND,  # one match, but nothing to change
        6: "Masked 2 item(s): 1 date, 1 ip_address",
    }


def test_reports(df):
    done = redact(df)
    entities = {r["entity"]: tuple(r)[1:] for r in reports.entity_report(done).collect()}
    assert entities == {"phone": (1, 1), "name": (3, 2), "email": (13, 2), "date": (1, 1), "ip_address": (1, 1)}
    groups = {r["grp"]: tuple(r)[1:] for r in reports.group_report(done, "grp").collect()}
    assert groups == {"a": (3, 3, 18, 1.0), "b": (1, 0, 0, 0.0), None: (1, 0, 1, 0.0)}
    assert [tuple(r) for r in reports.riskiest(done, "id", 2).collect()] == [(2, 13, 2), (1, 3, 2)]
    per_text = {(r["id"], r["entity"]): r["n_matches"] for r in reports.text_report(done, "id").collect()}
    assert per_text[2, "email"] == 12 and len(per_text) == 7
    totals = reports.corpus_totals(scan(df)).first().asDict()
    texts = [t for _, _, t in ROWS if t is not None]
    assert totals == {
        "n_rows": 6, "n_no_text": 1, "n_bytes": sum(len(t.encode()) for t in texts),
        "n_chars": sum(map(len, texts)), "n_changed": 3, "n_matches": 19, "n_entities": 5,
    }


def test_rule_counters_leave_custom_names_out(df):
    done = redact(df, "text", Policy(custom_names=("clean",)))
    got = {r["switch"]: r["n_matches"] for r in reports.rule_counters(done).collect()}
    assert got == {
        "redact_phone": 1, "redact_names_in_salutations": 3, "redact_email": 13, "redact_dates": 1,
        "redact_ip_addresses": 1,
    }
    assert reports.entity_report(done).filter("entity = 'name'").first()["n_matches"] == 4


def test_observed(df):
    done, seen = reports.observed(redact(df), "run")
    done.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_docs": 5, "n_changed": 3, "n_matches": 19}


def test_rescan_finds_nothing_left_to_change(spark, sf_dir, df):
    for table in (df, documents(spark, sf_dir)):
        again = audits.rescan(table).agg(
            F.count_if("changed").alias("first"), F.count_if("changed_again").alias("again")
        ).first()
        assert again["first"] > 0 and again["again"] == 0


def test_rule_ablation(spark, df):
    call = spark.createDataFrame([("Call 555-123-4567",)], "text string")
    got = {tuple(r) for r in audits.rule_ablation(call).collect()}
    assert ("all", "", "phone", 1, 1) in got
    assert ("off", "phone", "account_like", 1, 1) in got
    assert ("only", "account_like", "account_like", 1, 1) in got
    assert not any(mode == "only" and rule not in ("phone", "account_like") for mode, rule, *_ in got)
    # Each run equals a run under that constant policy.
    got = {}
    for r in audits.rule_ablation(df).collect():
        got.setdefault((r["mode"], r["rule"]), {})[r["entity"]] = (r["n_matches"], r["n_docs"])
    for entity in ENTITIES:
        for mode, policy in (("off", Policy.without(entity)), ("only", Policy.only(entity))):
            want = reports.entity_report(redact(df, "text", policy)).collect()
            assert got.get((mode, entity), {}) == {r["entity"]: tuple(r)[1:] for r in want}


def test_rule_ablation_copies_a_text_for_its_own_rules_only(spark):
    """A text is run again for each entity found in it, not for each variant, and not at all if nothing is."""
    texts = [("Call 555-123-4567",), ("mail a@b.org on 1996-01-02",), ("nothing",), (None,)]
    runs = audits._runs(spark.createDataFrame(texts, "text string"), "text").collect()
    assert sorted(r["__off"] for r in runs) == ["", "", "date", "email", "phone"]
    assert sorted(r["__again"] or "" for r in runs) == ["", "", texts[0][0], texts[1][0], texts[1][0]]


def test_restore_allowlist(spark):
    df = spark.createDataFrame([("XXXX XX XXXXX", None)], "a string, b string")
    row = restore_allowlist(restore_allowlist(df, "a", ["", "Acme", "Xi"]), "b", ["x"]).first()
    assert tuple(row) == ("Acme Xi AcmeX", None)


def test_result_does_not_depend_on_partitioning(spark, sf_dir):
    table = documents(spark, sf_dir)
    one = redact(table.coalesce(1)).orderBy("doc_id").collect()
    assert one == redact(table.repartition(13)).orderBy("doc_id").collect()


# --- plans -------------------------------------------------------------------


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_redaction_does_not_shuffle_and_reads_what_it_needs(spark, sf_dir):
    out = redact(documents(spark, sf_dir)).select("doc_id", "redacted_text")
    plan = executed(out)
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "IsNotNull(text)" in plan


def test_filters_on_results_do_not_copy_the_passes(spark, sf_dir):
    done = redact(documents(spark, sf_dir))
    plain = len(str(done._jdf.queryExecution().optimizedPlan()))
    kept = done.filter("changed AND n_matches > 1").filter("lang = 'en'")
    filtered = str(kept._jdf.queryExecution().optimizedPlan())
    assert len(filtered) < 1.2 * plain
    # The filter on an input column reaches the scan.
    assert "EqualTo(lang,en)" in executed(kept)


def test_rules_that_are_off_are_not_in_the_plan(spark, sf_dir):
    plan = plan_of(redact(documents(spark, sf_dir), "text", Policy.only("ssn")))
    assert plan_of(redact(documents(spark, sf_dir))).count("regexp_extract_all") > plan.count("regexp_extract_all")
    assert "passport" not in plan and "[pP][aA]" not in plan


def test_columns_nobody_asks_for_are_not_computed(spark, sf_dir):
    plan = executed(redact(documents(spark, sf_dir)).select("redacted_text"))
    assert "map_from_entries" not in plan and "'seq'" not in plan and "seq," not in plan


def test_reports_count_before_they_shuffle(spark, sf_dir):
    plan = executed(reports.entity_report(redact(documents(spark, sf_dir))))
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


# --- streams -----------------------------------------------------------------


def test_stream_equals_batch(spark, sf_dir):
    table = documents(spark, sf_dir)
    source, base = new_folder(spark), new_folder(spark)
    table.repartition(5).write.parquet(source)
    stream = jobs.read_text_stream(spark, source, table.schema, maxFilesPerTrigger=2)
    jobs.start_redaction(stream, f"{base}/sink", f"{base}/state").awaitTermination()
    got = spark.read.parquet(f"{base}/sink").orderBy("doc_id").collect()
    assert got == redact(table).orderBy("doc_id").collect()


def test_policies_are_read_anew_for_each_batch(spark):
    source, base, rules = new_folder(spark), new_folder(spark), new_folder(spark)
    schema = "id int, scope string, text string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run(policy):
        policy_table(spark, {"a": policy}).write.mode("overwrite").parquet(rules)
        stream = jobs.read_text_stream(spark, source, schema)
        jobs.start_governed_redaction(
            stream, lambda s: s.read.parquet(rules), "scope", f"{base}/sink", f"{base}/state"
        ).awaitTermination()

    add([(1, "a", "mail a@b.org, call 555-123-4567"), (2, "z", "mail a@b.org")])
    run(Policy.only("email"))
    add([(3, "a", "mail a@b.org")])
    run(Policy(enabled=False))
    add([(4, "a", "call 555-123-4567"), (5, "a", None)])
    run(Policy())
    rows = spark.read.parquet(f"{base}/sink/rows")
    assert {r["id"]: r["redacted_text"] for r in rows.collect()} == {
        1: "mail XXX@b.org, call 555-123-4567", 2: "mail XXX@b.org", 4: "call XXX-XXX-XXXX",
    }
    assert {r["id"]: r["summary"] for r in rows.collect()}[4] == "Masked 1 item(s): 1 phone"
    notices = spark.read.parquet(f"{base}/sink/notices").drop("batch").collect()
    assert sorted(map(tuple, notices)) == [("a", "email", 1, 1), ("a", "phone", 1, 1), ("z", "email", 1, 1)]


def test_windowed_counts(spark):
    source, base = new_folder(spark), new_folder(spark)
    schema = "ts timestamp, text string"

    def add(*rows):
        made = [(dt.datetime(2024, 1, 1, h, m), t) for h, m, t in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = jobs.read_text_stream(spark, source, schema)
        counts = jobs.windowed_counts(stream, "ts", delay="10 minutes")
        counts.writeStream.format("parquet").outputMode("append").option(
            "path", f"{base}/sink").option("checkpointLocation", f"{base}/state").trigger(
            **jobs.DRAIN).start().awaitTermination()
        got = spark.read.parquet(f"{base}/sink").collect()
        return sorted((r["window_start"].hour, r["entity"], r["n_matches"]) for r in got)

    add((9, 10, "a@b.org c@d.org"), (9, 50, "a@b.org 192.168.1.100"), (10, 30, "Dear Bob"))
    assert run() == [(9, "email", 3), (9, "ip_address", 1)]
    # Late by more than the delay after the window was closed: left out.
    add((9, 5, "a@b.org"), (12, 0, "x"))
    assert run() == [(9, "email", 3), (9, "ip_address", 1), (10, "name", 1)]


def test_findings_hold_no_text(df):
    out = findings(redact(df), "id")
    assert out.columns == ["id", "seq", "pass", "entity", "start", "end", "matched_len"]
    assert sorted(tuple(r) for r in out.filter("id = 1").collect()) == [
        (1, 0, 3, "phone", 57, 73, 16), (1, 1, 15, "name", 6, 11, 5), (1, 2, 16, "name", 125, 136, 11),
    ]
