"""Redaction of a text column, and the findings it leaves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.expressions import SPANS, quoted
from inkveil.functions.rules import Rule
from inkveil.operators import passes as P
from inkveil.sources.policies import Policy

# Matches per entity, as a map with at most one entry per entity.
COUNTS = (
    "map_from_entries(transform(array_distinct(__state.found.entity), "
    "e -> named_struct('entity', e, 'n', size(filter(__state.found.entity, x -> x = e)))))"
)
# The same without what was protected, whose records have the pass 0.
MASKED = "filter(__state.found, r -> r.pass <> 0)"
MASKED_COUNTS = COUNTS.replace("__state.found", MASKED)
MASKED_SPANS = (
    f"transform(filter({SPANS}, m -> m.pass <> 0), (m, i) -> named_struct('seq', i, 'pass', m.pass, "
    "'entity', m.entity, 'start', m.start, 'end', m.end))"
)


def results(closed: DataFrame, text: str, columns: list[str],
            restored: Column | None = None, protects: bool = False) -> DataFrame:
    """Turn the closed state into result columns."""
    counts, spans = (MASKED_COUNTS, MASKED_SPANS) if protects else (COUNTS, SPANS)
    found = F.expr(MASKED) if protects else F.col("__state.found")
    final = F.col("__state.text") if restored is None else restored
    original = F.col(quoted(text))
    read = original.isNotNull()
    return closed.withColumn("redacted_text", final).select(
        *(F.col(quoted(c)) for c in columns),
        "redacted_text",
        (F.col("redacted_text") != original).alias("changed"),
        F.when(read, F.size(found)).alias("n_matches"),
        F.when(read, F.expr(counts)).alias("entity_counts"),
        F.when(read, F.expr(spans)).alias("matches"),
    )


def _literal_list(values: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def close_with_tokens(state: DataFrame, text: str, columns: list[str],
                      tokens: tuple[str, ...], protects: bool = False) -> DataFrame:
    closed = P.close_state(state, columns)
    if not tokens:
        return results(closed, text, columns, protects=protects)
    listed = closed.withColumn("__tokens", _literal_list(tokens))
    return results(listed, text, columns, P.restored("__state.text", "__tokens"), protects)


def scan(df: DataFrame, text: str = "text", policy: Policy | None = None, rules: Sequence[Rule] = ()) -> DataFrame:
    """All columns of ``df`` plus the result columns; NULL texts stay, with
    NULL results. A disabled policy lets no row through. ``rules`` of the
    caller run after the library's, in their order."""
    policy = policy or Policy()
    columns = df.columns
    if not policy.enabled:
        df = df.filter(F.lit(False))
    protected = P.tokens_sql(policy.protected_tokens)
    state = P.run_rules(P.start_state(df, text), policy.switches(rules), rules, protected)
    first = P.FIRST_CUSTOM_PASS + len(rules)
    if len(policy.custom_names) > P.FEW_NAMES:
        listed = state.withColumn("__list", _literal_list(policy.custom_names))
        state = P.mask_names(listed, P.numbered_names("__list"), first, protected)
    else:
        state = P.mask_name_list(state, policy.custom_names, first, protected)
    return close_with_tokens(state, text, columns, policy.allowlist_tokens, bool(protected))


def redact(df: DataFrame, text: str = "text", policy: Policy | None = None, rules: Sequence[Rule] = ()) -> DataFrame:
    """Redact a text column, by the library's rules and by ``rules`` of the caller.

    Returns the other columns with ``redacted_text``, ``changed``,
    ``n_matches``, ``entity_counts`` (``map<entity,n>``) and ``matches``
    (``array<struct<seq,pass,entity,start,end>>``); what a caller does not
    select is not computed. Rows without a text have no output; unchanged rows
    do. No shuffle.
    """
    return scan(df.filter(F.col(quoted(text)).isNotNull()), text, policy, rules).drop(text)


def findings(redacted: DataFrame, *key: str) -> DataFrame:
    """One row per match of a ``redact`` result. The matched text is not kept;
    start and end are bytes in the text that the pass of the match has seen."""
    return (
        redacted.select(*key, F.inline("matches"))
        .withColumn("matched_len", F.col("end") - F.col("start"))
    )


def restore_allowlist(df: DataFrame, column: str, tokens: list[str]) -> DataFrame:
    """Put the tokens back over runs of marks of their length, in list order."""
    listed = df.withColumn("__tokens", _literal_list(tuple(tokens)))
    return listed.withColumn(column, P.restored(quoted(column), "__tokens")).drop("__tokens")
