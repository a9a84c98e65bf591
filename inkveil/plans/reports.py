"""Reports over a ``redact`` result.

All of them count within the row first (``entity_counts``), so what is
shuffled is at most one partial sum per group and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from inkveil.functions.expressions import quoted
from inkveil.functions.rules import RULES, Rule

# The wording of the summaries, here and in summary_line.
NOTHING_FOUND = "No sensitive data detected."


def entity_report(redacted: DataFrame, *by: str) -> DataFrame:
    """Matches and texts per entity, within the groups ``by``."""
    return (
        redacted.select(*by, F.explode("entity_counts").alias("entity", "n"))
        .groupBy(*by, "entity")
        .agg(F.sum("n").alias("n_matches"), F.count(F.lit(1)).alias("n_docs"))
    )


def text_report(redacted: DataFrame, *key: str) -> DataFrame:
    """Matches per text and entity."""
    return redacted.select(*key, F.explode("entity_counts").alias("entity", "n_matches"))


def _totals() -> list[Column]:
    changed = F.sum(F.col("changed").cast("int"))
    return [
        F.count(F.lit(1)).alias("n_docs"),
        changed.alias("n_changed"),
        F.sum("n_matches").alias("n_matches"),
        (changed / F.count(F.lit(1))).alias("changed_share"),
    ]


def group_report(redacted: DataFrame, *by: str) -> DataFrame:
    """Texts, changed texts, matches and the changed share per group."""
    return redacted.groupBy(*by).agg(*_totals())


def rollup_report(redacted: DataFrame, *by: str) -> DataFrame:
    """``group_report`` with subtotals; NULL stands for all."""
    return redacted.rollup(*by).agg(*_totals())


def riskiest(redacted: DataFrame, key: str, k: int) -> DataFrame:
    """The k texts with the most matches."""
    n_entities = F.size("entity_counts").alias("n_entities")
    return (
        redacted.select(key, "n_matches", n_entities)
        .orderBy(F.desc("n_matches"), key)
        .limit(k)
    )


def summary_line() -> Column:
    """One sentence per text; the counts are sorted as strings."""
    parts = F.expr("transform(map_entries(entity_counts), e -> concat(e.value, ' ', e.key))")
    return F.when(
        F.col("changed"),
        F.concat(
            F.lit("Masked "), F.col("n_matches"), F.lit(" item(s): "),
            F.array_join(F.array_sort(parts), ", "),
        ),
    ).when(~F.col("changed"), F.lit(NOTHING_FOUND))


def summaries(redacted: DataFrame, *key: str) -> DataFrame:
    """Per text: number of matches, number of different entities, sentence."""
    return redacted.select(
        *key, "n_matches", F.size("entity_counts").alias("n_entities"),
        summary_line().alias("summary"),
    )


def rule_counters(redacted: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """Matches per switch, those of the caller's ``rules`` included. Custom names have no switch and do not count."""
    of_rules = f"filter(matches, m -> m.pass <= {len(RULES) + len(rules)}).entity"
    counts = (
        f"transform(array_distinct({of_rules}), "
        f"e -> named_struct('entity', e, 'n', size(filter({of_rules}, x -> x = e))))"
    )
    toggles = F.create_map(*(F.lit(v) for r in {r.entity: r for r in (*RULES, *rules)}.values()
                             for v in (r.entity, r.toggle)))
    return (
        redacted.select(F.inline(F.expr(counts)))
        .groupBy("entity")
        .agg(F.sum("n").alias("n_matches"))
        .select(toggles[F.col("entity")].alias("switch"), "n_matches")
    )


def corpus_totals(scanned: DataFrame, text: str = "text") -> DataFrame:
    """One row about a whole table, from ``scan`` (which keeps NULL texts)."""
    # There are at most 2^12 different sets of entities.
    kinds = F.flatten(F.collect_set(F.map_keys("entity_counts")))
    original = F.col(quoted(text))
    return scanned.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(original.isNull()).alias("n_no_text"),
        F.sum(F.octet_length(original).cast("long")).alias("n_bytes"),
        F.sum(F.char_length(original).cast("long")).alias("n_chars"),
        F.count_if("changed").alias("n_changed"),
        F.sum("n_matches").alias("n_matches"),
        F.size(F.array_distinct(kinds)).alias("n_entities"),
    )


def observed(redacted: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, with running counts that any action on them fills in."""
    seen = Observation(name)
    return redacted.observe(
        seen,
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if("changed").alias("n_changed"),
        F.sum("n_matches").alias("n_matches"),
    ), seen
