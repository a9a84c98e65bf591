"""Policies: which rules run, which names to hide, which tokens to restore."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.functions.own_rules import OWN, own_switches
from inkveil.functions.rules import TOGGLES, Rule

SWITCHES = tuple(TOGGLES.values())
POLICY_SCHEMA = T.StructType(
    [T.StructField("scope", T.StringType()), T.StructField("enabled", T.BooleanType())]
    + [T.StructField(s, T.BooleanType()) for s in SWITCHES]
    + [
        T.StructField("custom_names", T.ArrayType(T.StringType())),
        T.StructField("allowlist_tokens", T.ArrayType(T.StringType())),
        T.StructField("protected_tokens", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class Policy:
    """One policy for a whole job. All rules are on, the lists are empty.

    ``allowlist_tokens`` are put back by length once all is masked. What a rule
    or a name finds and is one of the ``protected_tokens`` is not masked at all,
    leaves no record, and stays for the passes after it to see.

    ``off`` may also hold the switches of the caller's own rules; those that
    ``only`` and ``without`` leave on stay on.
    """

    enabled: bool = True
    off: frozenset[str] = field(default_factory=frozenset)
    custom_names: tuple[str, ...] = ()
    allowlist_tokens: tuple[str, ...] = ()
    protected_tokens: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        unknown = {s for s in self.off if not s.startswith(OWN)} - set(SWITCHES)
        if unknown:
            raise ValueError(f"unknown switches: {sorted(unknown)}")

    def switches(self, own: Sequence[Rule] = ()) -> dict[str, bool]:
        """Switches of all rules, the caller's ``own`` ones included; one that turns off a rule that is not there is an error."""
        known = (*SWITCHES, *own_switches(own))
        unknown = set(self.off) - set(known)
        if unknown:
            raise ValueError(f"no rule has the switches {sorted(unknown)}")
        return {s: s not in self.off for s in known}

    @classmethod
    def only(cls, entities: str | Iterable[str], **lists: tuple[str, ...]) -> Policy:
        """Just the rules of these entities."""
        names = [entities] if isinstance(entities, str) else list(entities)
        keep = {TOGGLES[e] for e in names}
        return cls(off=frozenset(SWITCHES) - keep, **lists)

    @classmethod
    def without(cls, entities: str | Iterable[str], **lists: tuple[str, ...]) -> Policy:
        """All rules but those of these entities."""
        names = [entities] if isinstance(entities, str) else list(entities)
        return cls(off=frozenset(TOGGLES[e] for e in names), **lists)

    def row(self, scope: str | None = None, own: Sequence[Rule] = ()) -> tuple:
        on = self.switches(own)
        return (
            scope, self.enabled, *(on[s] for s in SWITCHES),
            list(self.custom_names), list(self.allowlist_tokens), list(self.protected_tokens), *(on[s] for s in own_switches(own)),
        )


def policy_schema(own: Sequence[Rule] = ()) -> T.StructType:
    """The columns of a policy table; each entity that own rules add has a switch more."""
    return T.StructType(POLICY_SCHEMA.fields + [T.StructField(s, T.BooleanType()) for s in own_switches(own)])


def policy_table(spark: SparkSession, policies: dict[str, Policy], own: Sequence[Rule] = ()) -> DataFrame:
    """A policy table from a handful of policies, one row per scope."""
    return spark.createDataFrame([p.row(scope, own) for scope, p in policies.items()], policy_schema(own))


def with_defaults(policies: DataFrame, own: Sequence[Rule] = ()) -> DataFrame:
    """Fill what a partial policy leaves out: switches on, lists empty. A
    switch of an own rule that is not among ``own`` is an error."""
    schema = policy_schema(own)
    unknown = {c for c in policies.columns if c.startswith(OWN)} - set(schema.names)
    if unknown:
        raise ValueError(f"no rule has the switches {sorted(unknown)}")
    for f in schema.fields:
        if f.name not in policies.columns:
            policies = policies.withColumn(f.name, F.lit(None).cast(f.dataType))
    empty = F.array().cast("array<string>")
    return policies.select(
        "scope",
        *(F.coalesce(F.col(c), F.lit(True)).alias(c) for c in ("enabled", *SWITCHES, *own_switches(own))),
        F.coalesce("custom_names", empty).alias("custom_names"),
        F.coalesce("allowlist_tokens", empty).alias("allowlist_tokens"),
        F.coalesce("protected_tokens", empty).alias("protected_tokens"),
    )


def read_policies(spark: SparkSession, path: str, fmt: str = "json",
                  create: bool = False, own: Sequence[Rule] = (), **options) -> DataFrame:
    """Read a policy table; where there is none, the default policy holds.

    A record that is broken, holds a value of the wrong type or has no scope
    fails the job that reads it; no policy is ever taken for the default one.
    ``create=True`` also writes that default to ``path``.
    """
    try:
        found = spark.read.schema(policy_schema(own)).format(fmt).options(**{"mode": "FAILFAST"} | options).load(path)
        scope = F.coalesce("scope", F.raise_error(F.lit("a policy has no scope")).cast("string"))
        return with_defaults(found.withColumn("scope", scope), own)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
    default = policy_table(spark, {"default": Policy()}, own)
    if create:
        default.write.format(fmt).save(path)
    return with_defaults(default, own)


def policy_from_toml(text_or_path: str | Path) -> Policy:
    """One policy from a settings file (a ``Path``) or its text.

    ``enabled`` and the ``redaction`` section must be there; what the section
    leaves out takes its default. Keys this library has no use for are ignored.
    """
    raw = text_or_path.read_text("utf-8") if isinstance(text_or_path, Path) else text_or_path
    data = tomllib.loads(raw)
    if not isinstance(data.get("enabled"), bool):
        raise ValueError("settings need a boolean 'enabled'")
    rules = data.get("redaction")
    if not isinstance(rules, dict):
        raise ValueError("settings need a [redaction] section")
    for s in SWITCHES:
        if not isinstance(rules.get(s, True), bool):
            raise ValueError(f"'{s}' must be a boolean")
    for key in ("custom_names", "allowlist_tokens", "protected_tokens"):
        values = rules.get(key, [])
        if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
            raise ValueError(f"'{key}' must be a list of strings")
    return Policy(
        enabled=data["enabled"],
        off=frozenset(s for s in SWITCHES if rules.get(s, True) is False),
        custom_names=tuple(rules.get("custom_names", [])),
        allowlist_tokens=tuple(rules.get("allowlist_tokens", [])),
        protected_tokens=tuple(rules.get("protected_tokens", [])),
    )

