"""Streams whose batches are committed whole, tables that change while they run, and windows that end."""

from __future__ import annotations

import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkveil.functions.own_rules import own_rule
from inkveil.operators.redact import redact
from inkveil.plans.reports import rule_counters
from inkveil.sources.policies import Policy, policy_table
from inkveil.streaming import jobs

SCHEMA = "id long, scope string, text string"


def files(spark, folder, batches, schema=SCHEMA):
    """A stream of one batch for each list of rows, in their order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/part={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def wait(query):
    query.awaitTermination()


def test_a_batch_shows_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """Killed between rows and notices, a batch shows neither; run again, it shows both, once."""
    batches = [[(1, "x", "call 555-123-4567")], [(2, "x", "mail a@b.org")]]
    stream = files(spark, f"{tmp_path}/in", batches)
    sink, state = f"{tmp_path}/sink", f"{tmp_path}/state"
    policies = lambda s: policy_table(s, {"x": Policy()})
    real, calls = jobs.entity_report, []

    def failing(rows, *by):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(rows, *by)

    monkeypatch.setattr(jobs, "entity_report", failing)
    with pytest.raises(Exception, match="killed"):
        wait(jobs.start_governed_redaction(stream, policies, "scope", sink, state))
    assert spark.read.parquet(f"{sink}/rows").count() == 2  # the rows are there, but do not belong to a finished batch
    assert [r["id"] for r in jobs.committed(spark, sink, "rows").collect()] == [1]
    assert jobs.committed(spark, sink, "notices").count() == 1
    wait(jobs.start_governed_redaction(stream, policies, "scope", sink, state))
    assert sorted((r["id"], r["batch"]) for r in jobs.committed(spark, sink, "rows").collect()) == [(1, 0), (2, 1)]
    assert jobs.committed(spark, sink, "notices").count() == 2
    # The same batches once more, as after a lost checkpoint: committed ones stay as they are.
    wait(jobs.start_governed_redaction(stream, policies, "scope", sink, f"{tmp_path}/other"))
    assert jobs.committed(spark, sink, "rows").count() == 2


def test_versions_go_with_the_batches(spark, tmp_path):
    """A table that changes between batches has another version in the second commit, and one copy for each version."""
    stream = files(spark, f"{tmp_path}/in", [[(k, "x", "mail a@b.org B7")] for k in range(3)])
    rules = (own_rule("badge", r"B\d"),)
    seen = []

    def policies(s):
        seen.append(1)
        on = Policy() if len(seen) < 3 else Policy(off=frozenset({"redact_email", "redact_own_badge"}))
        return policy_table(s, {"x": on}, rules)

    sink = f"{tmp_path}/sink"
    wait(jobs.start_governed_redaction(stream, policies, "scope", sink, f"{tmp_path}/state", rules=rules))
    versions = [r["version"] for r in spark.read.parquet(f"{sink}/commits").orderBy("batch").collect()]
    assert versions[0] == versions[1] != versions[2]
    texts = [r["redacted_text"] for r in jobs.committed(spark, sink, "rows").orderBy("batch").collect()]
    assert texts == ["mail XXX@b.org XX"] * 2 + ["mail a@b.org B7"]


@pytest.mark.parametrize("options", [{}, {"lookup": 0}], ids=["looked up", "joined"])
def test_names_added_between_two_batches(spark, tmp_path, options):
    stream = files(spark, f"{tmp_path}/in", [[(k, "x", "Ada met Bob")] for k in range(3)])
    seen = []

    def names(s):
        seen.append(1)
        listed = [(1, "Ada")] if len(seen) == 1 else [(1, "Ada"), (2, "Bob")] if len(seen) == 2 else [(2, "Bob")]
        return s.createDataFrame(listed, "ord int, name string")

    sink = f"{tmp_path}/sink"
    wait(jobs.start_named_redaction(stream, names, sink, f"{tmp_path}/state", **options))
    rows = jobs.committed(spark, sink, "rows").orderBy("batch").collect()
    assert [r["redacted_text"] for r in rows] == ["XXX met Bob", "XXX met XXX", "Ada met XXX"]
    assert [[m["pass"] for m in r["matches"]] for r in rows] == [[17], [17, 18], [18]]


def test_pinned_tables_are_copied_once(spark):
    rows = [(1, "Ada")]
    pinned = jobs.Pinned(lambda s: s.createDataFrame(rows, "ord int, name string"))
    first, a = pinned.now(spark)
    assert pinned.now(spark) == (first, a)
    rows.append((1, "Ada"))
    second, b = pinned.now(spark)
    assert second != first and b.count() == 2
    assert jobs.version_of(a.repartition(3)) == first
    assert jobs.version_of(b.repartition(3)) == second


def test_windows_end_and_no_row_is_lost(spark, tmp_path):
    """Against a plain run over the batches: closed once each, late rows by the time of the batches before, all rows together."""
    start = datetime(2024, 1, 1)
    hours = [[0, 1, 5], [30, 2, 31], [3, 29, None], [100, 31, 4], [101, 99, 30], [102]]
    batches = [[(start + timedelta(hours=h) if h is not None else None, f"mail a{k}@b.org and 555-123-4567") for k, h in enumerate(x)] for x in hours]
    stream = files(spark, f"{tmp_path}/in", batches, "ts timestamp, text string")
    sink = f"{tmp_path}/sink"
    wait(jobs.start_ending_windows(stream, "ts", sink, f"{tmp_path}/state", width="10 hours", delay="5 hours"))
    anchor = int(start.timestamp() // 3600) % 10  # windows are aligned to 1970
    begin = lambda h: None if h is None else h - (h + anchor) % 10
    newest, open_, closed, late = None, {}, {}, {}
    for x in hours:
        limit = None if newest is None else newest - 5
        for h in x:
            w = begin(h)
            gone = w is None or limit is not None and w + 10 <= limit
            part = late if gone else open_
            part[w] = part.get(w, 0) + 1
        newest = max([newest or 0, *(h for h in x if h is not None)])
        for w in [w for w in open_ if w + 10 <= newest - 5]:
            assert w not in closed
            closed[w] = open_.pop(w)

    def counts(df):
        out = {}
        for r in df.groupBy("window_start", "entity").agg(F.sum("n_matches").alias("n")).collect():
            hour = None if r["window_start"] is None else int((r["window_start"].timestamp() - start.timestamp()) // 3600)
            out.setdefault(hour, set()).add(r["n"])
        return {h: n.pop() for h, n in out.items() if len(n) == 1}

    shut = jobs.committed(spark, sink, "closed")
    assert counts(shut) == closed and shut.groupBy("window_start", "entity").count().filter("count > 1").isEmpty()
    assert counts(jobs.committed(spark, sink, "late")) == late
    assert counts(jobs.open_windows(spark, sink)) == open_
    assert late and closed and open_


def test_counters_of_a_running_stream(spark, tmp_path):
    """Summed over the micro-batches, the log says what the counters of the whole table say."""
    rules = (own_rule("badge", r"B\d"),)
    batches = [[(k, "x", text), (10 + k, "x", "B7 " * k)] for k, text in enumerate(["mail a@b.org", "555-123-4567 and B1", "clean", ""])]
    batches[2].append((99, "x", None))
    stream = files(spark, f"{tmp_path}/in", batches)
    log = jobs.CounterLog(spark, f"{tmp_path}/counters")
    spark.streams.addListener(log)
    try:
        wait(jobs.start_redaction(stream, f"{tmp_path}/sink", f"{tmp_path}/state", rules=rules, counted=True))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        end = time.time() + 60
        while time.time() < end and (not Path(log.path).exists() or log.read().select("batch").distinct().count() < 4):
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(log)
    got = {r["counter"]: r["n"] for r in log.read().groupBy("counter").agg(F.sum("n").alias("n")).collect()}
    whole = redact(spark.createDataFrame([r for x in batches for r in x], SCHEMA), "text", None, rules)
    want = {r["switch"]: r["n_matches"] for r in rule_counters(whole, rules).collect()}
    assert {k: n for k, n in got.items() if n and k.startswith("redact_")} == want
    assert (got["n_docs"], got["n_changed"]) == (whole.count(), whole.filter("changed").count())


def test_processing_time(spark, tmp_path):
    """A stream that goes on takes what comes later, until it is stopped."""
    stream = files(spark, f"{tmp_path}/in", [[(1, "x", "mail a@b.org")]])
    query = jobs.start_redaction(stream, f"{tmp_path}/sink", f"{tmp_path}/state", trigger={"processingTime": "200 milliseconds"})
    try:
        query.processAllAvailable()
        spark.createDataFrame([(3, "x", "mail e@f.org")], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part=0")
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    got = {r["id"]: r["redacted_text"] for r in spark.read.parquet(f"{tmp_path}/sink").collect()}
    assert got[1] == "mail XXX@b.org" and got[3] == "mail XXX@f.org"
