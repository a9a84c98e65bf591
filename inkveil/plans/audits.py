"""Jobs that look at the rules themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.expressions import quoted
from inkveil.functions.rules import ENTITIES, TOGGLES
from inkveil.operators import passes as P
from inkveil.operators.redact import COUNTS, redact, scan
from inkveil.sources.policies import Policy


def rescan(df: DataFrame, text: str = "text", policy: Policy | None = None) -> DataFrame:
    """Redact, then redact the result: the other columns with ``changed``,
    ``n_matches`` of the first run and ``changed_again``, ``n_matches_again``."""
    once = redact(df, text, policy).drop("entity_counts", "matches").withColumnsRenamed(
        {"redacted_text": "__once", "changed": "__changed", "n_matches": "__n_matches"}
    )
    twice = scan(once, "__once", policy).drop("entity_counts", "matches", "__once", "redacted_text")
    return twice.withColumnsRenamed({
        "changed": "changed_again", "n_matches": "n_matches_again",
        "__changed": "changed", "__n_matches": "n_matches",
    })


#: Matches of one entity in one text under one variant.
_COUNT = "named_struct('mode', '{mode}', 'rule', {rule}, 'entity', {entity}, 'n', {n})"


def _runs(df: DataFrame, text: str) -> DataFrame:
    """Of each text with a match, a row of the counts that are known and one row with the text for each rule to be left out."""
    column = F.col(quoted(text))
    texts = scan(df.filter(column.isNotNull()).select(column.alias("__text")), "__text")
    rows = texts.filter("n_matches > 0").select("__text", F.col("entity_counts").alias("__known"))
    # Found once for all runs of a text.
    rows = rows.withColumn("__stretches", F.expr(P.numbers_of("__text")))
    for i, entity in enumerate(ENTITIES):
        alone = {t: t == TOGGLES[entity] for t in TOGGLES.values()}
        started = rows.withColumns({"__state": P.fresh_state("__text"), "__numbers": F.col("__stretches")})
        rows = P.run_rules(started, alone).withColumn(f"__alone_{i}", F.expr("size(__state.found)")).drop("__state")
    of_all = _COUNT.format(mode="all", rule="''", entity="k.key", n="k.value")
    of_off = _COUNT.format(mode="off", rule="e", entity="k.key", n="k.value")
    of_only = [_COUNT.format(mode="only", rule=f"'{e}'", entity=f"'{e}'", n=f"__alone_{i}") for i, e in enumerate(ENTITIES)]
    unfound = "filter(array(" + ", ".join(f"'{e}'" for e in ENTITIES) + "), e -> NOT map_contains_key(__known, e))"
    ready = (
        f"concat(transform(map_entries(__known), k -> {of_all}), "
        f"flatten(transform({unfound}, e -> transform(map_entries(__known), k -> {of_off}))), "
        f"filter(array({', '.join(of_only)}), x -> x.n > 0))"
    )
    runs = (
        "concat(array(named_struct('off', '', 'text', cast(NULL as string), 'numbers', cast(NULL as string), 'ready', {ready})), "
        "transform(map_keys(__known), e -> named_struct('off', e, 'text', __text, 'numbers', __stretches, 'ready', NULL)))"
    ).format(ready=ready)
    return rows.select(F.inline(F.expr(runs))).withColumnsRenamed({"off": "__off", "text": "__again", "numbers": "__numbers", "ready": "__ready"})


def rule_ablation(df: DataFrame, text: str = "text") -> DataFrame:
    """What each rule is worth: matches by entity with all rules on, with one
    rule off and with one rule alone, as (mode, rule, entity, n_matches, n_docs).

    A text in which no rule finds anything yields nothing under any selection
    of them, so only the others are run again. A run with a rule off is the run
    with all of them up to the rule's first match, and all of it if the rule has none
    in the text: such a variant takes the counts that are there. So a text is run
    again once for each entity found in it; each rule alone is a few passes, with
    constant switches, over the row that holds the text, which is not copied for that.
    """
    again = _runs(df, text)
    without = {t: f"__off <> '{e}'" for e, t in TOGGLES.items()}
    state = P.close_state(P.run_rules(again.withColumn("__state", P.fresh_state("__again")), without), ["__off", "__ready"])
    of_off = _COUNT.format(mode="off", rule="__off", entity="k.key", n="k.value")
    found = f"transform(map_entries({COUNTS}), k -> {of_off})"
    return (
        state.select(F.inline(F.expr(f"coalesce(__ready, {found})")))
        .groupBy("mode", "rule", "entity")
        .agg(F.sum("n").alias("n_matches"), F.count(F.lit(1)).alias("n_docs"))
    )
