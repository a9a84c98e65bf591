"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line. Every query runs to a ``noop`` sink, or to its own sink
if it is a stream, and is timed with the building and planning of its plan. The
given tables are single files of one row group, which one task reads; they
are first written anew as 16 files each, all rows of them, untimed.
``queries`` holds the median of three runs, ``first_runs`` the first one, when
much of the JVM's code is not compiled yet.
"""

from __future__ import annotations

import glob
import json
import os
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

from checks.queries import QUERIES

HEADLINE = [
    "redact_documents",
    "redact_pages",
    "redact_conversations",
    "redact_messages",
    "findings_documents",
    "entity_report_documents",
    "report_rollup",
    "corpus_totals",
    "summaries_documents",
    "redact_with_policy_documents",
    "redact_custom_names",
    "redact_name_dictionary",
    "redact_own_rules",
    "redact_protected",
    "rescan_documents",
    "rule_ablation_documents",
    "only_email",
    "only_account_like",
    "mask_name",
    "stream_documents",
]


FILES = 16


def spread_out(spark: SparkSession, sf_dir: str) -> str:
    """The same tables, each in FILES files, in a new folder."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        spark.read.parquet(path).repartition(FILES).write.parquet(f"{folder}/{os.path.basename(path)}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = spread_out(spark, sf_dir)
    runs: dict[str, list[float]] = {}
    for name in HEADLINE:
        for _ in range(3):
            begun = time.time()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            runs.setdefault(name, []).append(round(time.time() - begun, 3))
    seconds = {name: median(times) for name, times in runs.items()}
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "first_runs": {name: times[0] for name, times in runs.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "files": FILES,
    }))


if __name__ == "__main__":
    main()
