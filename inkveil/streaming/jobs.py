"""Redaction of streams of texts. Redaction itself needs no state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from inkveil.functions.expressions import quoted
from inkveil.functions.rules import RULES, Rule
from inkveil.operators.names import redact_names
from inkveil.operators.policy import redact_with_policy
from inkveil.operators.redact import redact
from inkveil.plans.reports import entity_report, summary_line
from inkveil.sources.policies import Policy
from inkveil.sources.tables import new_folder

# Work through what is there and stop; a service would rather use
# {"processingTime": "1 second"}.
DRAIN = {"availableNow": True}
LAST_BATCH = (1 << 62) - 1


def read_text_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                     **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def start_redaction(stream: DataFrame, sink: str, checkpoint: str, text: str = "text",
                    policy: Policy | None = None, trigger: dict | None = None,
                    fmt: str = "parquet", rules: Sequence[Rule] = (), counted: bool = False) -> StreamingQuery:
    """Redact a stream under one policy and append the rows to ``sink``; ``counted`` tells a ``CounterLog`` of each micro-batch."""
    out = redact(stream, text, policy, rules)
    if counted:
        out = counted_stream(out, rules)
    return (
        out.writeStream.format(fmt).outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DRAIN)).start()
    )


def committed(spark: SparkSession, sink: str, table: str) -> DataFrame:
    """The rows of a sink's table that belong to finished batches, with the column ``batch``.

    A batch writes its tables one after the other and its commit last. What a
    batch that was killed in between has left is not shown, in any table.
    """
    done = spark.read.parquet(f"{sink}/commits").select("batch")
    return spark.read.parquet(f"{sink}/{table}").join(F.broadcast(done), "batch")


def _last_commit(spark: SparkSession, sink: str, before: int) -> Row | None:
    try:
        found = spark.read.parquet(f"{sink}/commits")
    except AnalysisException as err:
        if err.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return found.filter(F.col("batch") < before).orderBy(F.desc("batch")).first()


def _finished(spark: SparkSession, sink: str, batch_id: int) -> bool:
    last = _last_commit(spark, sink, batch_id + 1)
    return last is not None and last["batch"] == batch_id


def _write(df: DataFrame, sink: str, table: str, batch_id: int) -> DataFrame:
    """A batch's part of a table; a batch that is run again overwrites its own."""
    path = f"{sink}/{table}/batch={batch_id}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _commit(spark: SparkSession, sink: str, batch_id: int, **facts: object) -> None:
    values = [F.lit(v).alias(k) for k, v in facts.items()]
    _write(spark.range(1).select(F.current_timestamp().alias("committed_at"), *values).coalesce(1), sink, "commits", batch_id)


def version_of(table: DataFrame) -> str:
    """A fingerprint of a table's rows, whatever their order."""
    values = F.xxhash64(*(F.to_json(F.struct(F.col(quoted(c)))) for c in table.columns))
    seen = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(values), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(values, F.lit(1 << 31))), F.lit(0)).alias("s")).first()
    return f"{seen['n']}-{seen['x'] & (1 << 64) - 1:016x}-{seen['s']:x}"


class Pinned:
    """A table that may change while a stream runs, read once for each version.

    The rows are written to a folder of the shared scratch and read from
    there, so whatever looks at the table during a batch sees the same rows. The
    copy is kept until the table's fingerprint is another.
    """

    def __init__(self, read: Callable[[SparkSession], DataFrame]) -> None:
        self.read, self.version, self.rows = read, None, None

    def now(self, spark: SparkSession) -> tuple[str, DataFrame]:
        current = self.read(spark)
        if self.rows is None or version_of(current) != self.version:
            path = new_folder(spark)
            current.write.parquet(path)
            self.rows = spark.read.schema(current.schema).parquet(path)
            # Of the copy: the table may have changed since it was looked at.
            self.version = version_of(self.rows)
        return self.version, self.rows


def _started(stream: DataFrame, run_batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DRAIN)).start()
    )


def _redaction_of(redacted: Callable[[DataFrame, DataFrame], DataFrame], table: Callable[[SparkSession], DataFrame],
                  by: tuple[str, ...], sink: str) -> Callable[[DataFrame, int], None]:
    """What a batch does: the rows, the notices counted from them, then the commit with the version of the table."""
    pinned = Pinned(table)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _finished(spark, sink, batch_id):
            return
        version, current = pinned.now(spark)
        rows = _write(redacted(batch, current).withColumn("summary", summary_line()), sink, "rows", batch_id)
        # Counted from the written rows, not by redacting the batch once more.
        _write(entity_report(rows, *by), sink, "notices", batch_id)
        _commit(spark, sink, batch_id, version=version)

    return run_batch


def start_governed_redaction(stream: DataFrame, policies: Callable[[SparkSession], DataFrame],
                             scope: str, sink: str, checkpoint: str, text: str = "text",
                             trigger: dict | None = None, rules: Sequence[Rule] = ()) -> StreamingQuery:
    """Redact a stream under a policy table that may change while it runs.

    ``policies`` is called for each micro-batch, so switching a scope off or on
    takes effect with the next one. A batch checks and follows one and the same
    version of the table. Each batch writes its own folders,

    * ``sink/rows/batch=<id>``: the redacted rows,
    * ``sink/notices/batch=<id>``: per scope and entity, matches and texts,
    * ``sink/commits/batch=<id>``, last: the version of the table,

    and a batch that is run again overwrites them, or leaves them if it was
    committed. ``committed`` reads what belongs to finished batches.
    """

    def redacted(batch: DataFrame, current: DataFrame) -> DataFrame:
        return redact_with_policy(batch, current, scope, text, rules=rules)

    return _started(stream, _redaction_of(redacted, policies, (scope,), sink), checkpoint, trigger)


def start_named_redaction(stream: DataFrame, names: Callable[[SparkSession], DataFrame], sink: str,
                          checkpoint: str, text: str = "text", policy: Policy | None = None,
                          trigger: dict | None = None, rules: Sequence[Rule] = (), **options) -> StreamingQuery:
    """Redact a stream with custom names from a table (ord, name) that may change while it runs.

    Names that are added or removed between two batches count from the second
    one on; a table that stays the same is copied once. The sink is that of
    ``start_governed_redaction``; ``options`` are those of ``redact_names``.
    """

    def redacted(batch: DataFrame, current: DataFrame) -> DataFrame:
        return redact_names(batch, current, text, policy, rules=rules, **options)

    return _started(stream, _redaction_of(redacted, names, (), sink), checkpoint, trigger)


COUNTERS = "rule counters"


def counted_stream(redacted: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """The same rows, with running counts of each micro-batch for ``CounterLog``: texts, changed ones, and matches by switch."""
    of_rules = f"filter(matches, m -> m.pass <= {len(RULES) + len(rules)}).entity"
    toggles = {r.entity: r.toggle for r in (*RULES, *rules)}
    sums = {t: [e for e, x in toggles.items() if x == t] for t in dict.fromkeys(toggles.values())}
    hits = {t: " + ".join(f"size(filter({of_rules}, x -> x = '{e}'))" for e in es) for t, es in sums.items()}
    return redacted.observe(
        COUNTERS, F.count(F.lit(1)).alias("n_docs"), F.count_if("changed").alias("n_changed"),
        *(F.coalesce(F.sum(F.expr(x).cast("long")), F.lit(0)).alias(t) for t, x in hits.items()),
    )


class CounterLog(StreamingQueryListener):
    """Appends the counters of each finished micro-batch to a table, as (query, batch, counter, n).

    Each batch of a query has a folder of its own, so one that is reported again
    replaces its counts. Put it on with ``spark.streams.addListener``.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        found = progress.observedMetrics.get(COUNTERS)
        if found is None:
            return
        query, batch = str(progress.id), progress.batchId
        rows = [(query, batch, name, n) for name, n in found.asDict().items()]
        table = self.spark.createDataFrame(rows, "query string, batch long, counter string, n long")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/of={query}-{batch}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("of")


def windowed_counts(rows: DataFrame, ts: str, width: str = "1 hour", delay: str | None = None,
                    text: str = "text", policy: Policy | None = None) -> DataFrame:
    """Matches per entity and window of event time, for a table or a stream.

    All rows and all windows count. Only with a ``delay`` does a stream leave
    out rows that come later than that behind the newest one, and let go of the
    windows before it; the only state is one running sum per window and entity.
    """
    redacted = redact(rows.withWatermark(ts, delay) if delay else rows, text, policy)
    return (
        redacted.select(ts, F.explode("entity_counts").alias("entity", "n"))
        .groupBy(F.window(ts, width).alias("w"), "entity")
        .agg(F.sum("n").alias("n_matches"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "entity", "n_matches",
        )
    )


def start_ending_windows(stream: DataFrame, ts: str, sink: str, checkpoint: str, width: str = "1 hour",
                         delay: str = "1 hour", text: str = "text", policy: Policy | None = None,
                         trigger: dict | None = None) -> StreamingQuery:
    """Counts per entity and window of a stream, with windows that end and no row that is lost.

    A window is closed once a row is more than ``delay`` newer than its end, by
    the batches before. Each batch adds its counts to the open windows and writes

    * ``sink/closed/batch=<id>``: the windows that its end closes, with their counts, each window once,
    * ``sink/late/batch=<id>``: counts of rows whose window was closed before,
    * ``sink/open/turn=<id modulo 2>``: the open windows; the other one is the state before,
    * ``sink/commits/batch=<id>``, last: the newest time so far.

    Closed and late counts and those of the last state make up all rows. What is
    kept follows the number of open windows. Rows without a time are late, in a window of null.
    """

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _finished(spark, sink, batch_id):
            return
        last = _last_commit(spark, sink, batch_id)
        newest = None if last is None else last["newest"]
        newer = batch.agg(F.max(F.col(quoted(ts)).cast("timestamp")).alias("t")).first()["t"]
        end = max((t for t in (newest, newer) if t is not None), default=None)
        passed = lambda t: F.coalesce(F.col("window_end") <= F.lit(t).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(False))
        redacted = redact(batch, text, policy).withColumn("w", F.window(F.col(quoted(ts)).cast("timestamp"), width))
        # The window function leaves rows without a time out, so those are added by hand.
        timeless = redact(batch.filter(F.col(quoted(ts)).isNull()), text, policy)
        none = F.lit(None).cast("timestamp")
        rows = redacted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "entity_counts").unionByName(
            timeless.select(none.alias("window_start"), none.alias("window_end"), "entity_counts")
        )
        keys = ("window_start", "window_end", "entity")
        counts = rows.select("window_start", "window_end", F.explode("entity_counts").alias("entity", "n")).groupBy(*keys).agg(F.sum("n").alias("n_matches"))
        counts = _write(counts.withColumn("late", F.col("window_end").isNull() | (passed(newest) if newest is not None else F.lit(False))), sink, "counted", 0)
        _write(counts.filter("late").drop("late"), sink, "late", batch_id)
        now = counts.filter("NOT late").drop("late")
        if last is not None:
            now = now.unionByName(spark.read.schema(now.schema).parquet(f"{sink}/open/turn={(batch_id + 1) % 2}"))
        now = now.groupBy(*keys).agg(F.sum("n_matches").alias("n_matches"))
        closed = passed(end) if end is not None else F.lit(False)
        _write(now.filter(closed), sink, "closed", batch_id)
        now.filter(~closed).write.mode("overwrite").parquet(f"{sink}/open/turn={batch_id % 2}")
        _commit(spark, sink, batch_id, newest=end)

    return _started(stream, run_batch, checkpoint, trigger)


def open_windows(spark: SparkSession, sink: str) -> DataFrame:
    """The windows of ``start_ending_windows`` that the last finished batch has left open."""
    last = _last_commit(spark, sink, LAST_BATCH)
    return spark.read.parquet(f"{sink}/open/turn={last['batch'] % 2}")


def start_windowed_counts(stream: DataFrame, ts: str, sink: str, checkpoint: str,
                          width: str = "1 hour", text: str = "text",
                          policy: Policy | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Keep the counts of all windows of a stream, whatever the order of its rows.

    Each batch writes the counts so far to ``sink/batch=<id>``; the highest one
    holds them all, and a batch that is run again overwrites its own. No row is
    late. The state grows with the number of windows, and the output with that
    of windows and batches: this is for input that ends. A service takes
    ``start_ending_windows``.
    """

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        windowed_counts(stream, ts, width, None, text, policy)
        .writeStream.outputMode("complete").foreachBatch(run_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DRAIN)).start()
    )
