"""Redaction under a table of policies: each row follows the policy of its scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.expressions import quoted
from inkveil.functions.own_rules import own_switches
from inkveil.functions.rules import Rule
from inkveil.operators import passes as P
from inkveil.operators.joins import BROADCAST_BYTES, join_lookup
from inkveil.operators.redact import results
from inkveil.sources.policies import SWITCHES, with_defaults


def run_policy(df: DataFrame, text: str, columns: list[str], own: Sequence[Rule] = (),
               protects: bool = True) -> DataFrame:
    """Redact by the policy in the column ``__policy`` of each row; rows
    without one follow the default, rows of a disabled one are left out."""
    ready = df.filter(F.col(quoted(text)).isNotNull() & F.expr("coalesce(__policy.enabled, true)"))
    switches = {s: f"coalesce(__policy.{s}, true)" for s in (*SWITCHES, *own_switches(own))}
    protected = "__policy.protected_tokens" if protects else ""
    state = P.run_rules(P.start_state(ready, text), switches, own, protected)
    state = P.mask_names(state, P.numbered_names("__policy.custom_names"), P.FIRST_CUSTOM_PASS + len(own), protected)
    closed = P.close_state(state, [*columns, "__policy"])
    restored = F.coalesce(P.restored("__state.text", "__policy.allowlist_tokens"), F.col("__state.text"))
    return results(closed, text, columns, restored, protects)


def redact_with_policy(df: DataFrame, policies: DataFrame, scope: str, text: str = "text",
                       limit: int = BROADCAST_BYTES, rules: Sequence[Rule] = ()) -> DataFrame:
    """Like ``redact``, with the policy whose ``scope`` equals the column
    ``scope`` of the row. One policy per scope. The table may hold a switch
    for each entity that ``rules`` add; they run where there is none."""
    complete = with_defaults(policies.filter(F.col("scope").isNotNull()), rules)
    counted = complete.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("protected_tokens")).alias("tokens"))
    worst = counted.agg(F.max(F.struct("n", "scope")).alias("most"), F.max("tokens").alias("tokens")).first()
    if worst["most"] and worst["most"]["n"] > 1:
        raise ValueError(f"more than one policy for scope {worst['most']['scope']!r}")
    lookup = complete.select(
        F.col("scope").alias("__scope"), F.struct(*complete.columns[1:]).alias("__policy")
    )
    scoped = df.withColumn("__scope", F.col(quoted(scope)).cast("string"))
    joined = join_lookup(scoped, lookup, "__scope", "left", limit)
    return run_policy(joined, text, df.columns, rules, bool(worst["tokens"])).drop(text)
