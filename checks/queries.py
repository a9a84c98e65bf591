"""The registered queries: each one with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import duck
from checks.messages import messages, messages_sql
from inkveil.functions import masks as M
from inkveil.functions.own_rules import own_rule
from inkveil.functions.rules import ENTITIES, TOGGLES
from inkveil.operators.names import redact_names
from inkveil.operators.policy import redact_with_policy
from inkveil.operators.redact import findings, redact, restore_allowlist, scan
from inkveil.plans import audits, reports
from inkveil.sources.policies import Policy, policy_table, read_policies
from inkveil.sources.tables import new_folder, read_texts, write_texts
from inkveil.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MESSAGES = messages_sql()
DOCUMENTS = "SELECT doc_id, text, lang, source FROM documents"


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, table(spark, sf_dir, "orders"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def flat(redacted: DataFrame, *keys: str) -> DataFrame:
    return redacted.select(*keys, "redacted_text", "changed", "n_matches")


# --- Redacted tables -------------------------------------------------------

register(
    "redact_documents",
    lambda s, d: flat(redact(docs(s, d)), "doc_id"),
    duck.redacted(DOCUMENTS, "text", "doc_id"),
)
register(
    "redact_pages",
    lambda s, d: flat(redact(pages(s, d), "html"), "page_id", "url"),
    duck.redacted("SELECT page_id, url, html FROM pages", "html", "page_id, url"),
)
register(
    "redact_conversations",
    lambda s, d: flat(redact(turns(s, d)), "conv_id", "turn"),
    duck.redacted("SELECT conv_id, turn, text FROM conversations", "text", "conv_id, turn"),
)
register(
    "redact_messages",
    lambda s, d: flat(redact(mails(s, d)), "msg_id"),
    duck.redacted(MESSAGES, "text", "msg_id"),
)
register(
    "changed_documents",
    lambda s, d: flat(redact(docs(s, d)), "doc_id").filter("changed"),
    f"SELECT * FROM ({duck.redacted(DOCUMENTS, 'text', 'doc_id')}) WHERE changed",
)


def _written(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s)
    write_texts(redact(docs(s, d)), path)
    return flat(read_texts(s, path), "doc_id")


register("written_documents", _written, duck.redacted(DOCUMENTS, "text", "doc_id"))


def _round_trip(s: SparkSession, d: str, fmt: str) -> DataFrame:
    """Texts written in a format, read from it and redacted, and the result written and read once more."""
    path, out = new_folder(s), new_folder(s)
    plain = docs(s, d).select("doc_id", "text", "lang")
    if fmt == "csv":
        plain.write.option("header", True).option("escape", '"').option("nullValue", "\0").csv(path)
    else:
        plain.write.format(fmt).save(path)
    more = {"multiLine": True} if fmt == "csv" else {}
    done = redact(read_texts(s, path, fmt, plain.schema, **more))
    write_texts(done, out, fmt)
    schema = "doc_id bigint, lang string, redacted_text string, changed boolean, n_matches int"
    return flat(read_texts(s, out, fmt, schema, **more), "doc_id", "lang")


for _fmt in ("json", "orc", "csv"):
    register(
        f"written_{_fmt}",
        lambda s, d, f=_fmt: _round_trip(s, d, f),
        duck.redacted(DOCUMENTS, "text", "doc_id, lang"),
    )


def _lines(s: SparkSession, d: str) -> DataFrame:
    """The redacted messages as a text file, line by line."""
    path = new_folder(s)
    write_texts(redact(mails(s, d)), path, "text")
    return read_texts(s, path, "text").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


register(
    "written_text",
    _lines,
    f"WITH {duck.staged(MESSAGES, 'text')} SELECT value, count(*) AS n FROM "
    "(SELECT unnest(string_split(t, chr(10))) AS value FROM done) GROUP BY value",
)

# --- Findings --------------------------------------------------------------

_FOUND = (
    "SELECT {key}, CAST(i - 1 AS INT) AS seq, m[i].pass AS pass, m[i].entity AS entity, "
    "m[i].s AS \"start\"{more} FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM done)"
)
# RE2 knows word boundaries of ASCII only, so on texts with other letters an
# account number may end one blank earlier there: ends are compared on messages.
register(
    "findings_documents",
    lambda s, d: findings(redact(docs(s, d)), "doc_id").select(
        "doc_id", "seq", "pass", "entity", "start"
    ),
    f"WITH {duck.staged(DOCUMENTS, 'text')} " + _FOUND.format(key="doc_id", more=""),
)
register(
    "findings_pages",
    lambda s, d: findings(redact(pages(s, d), "html"), "page_id").select(
        "page_id", "seq", "pass", "entity", "start"
    ),
    f"WITH {duck.staged('SELECT page_id, html FROM pages', 'html')} "
    + _FOUND.format(key="page_id", more=""),
)
register(
    "findings_messages",
    lambda s, d: findings(redact(mails(s, d)), "msg_id"),
    f"WITH {duck.staged(MESSAGES, 'text')} " + _FOUND.format(
        key="msg_id", more=', m[i].e AS "end", m[i].e - m[i].s AS matched_len'
    ),
)

# --- Reports ---------------------------------------------------------------

_HITS = "SELECT *, unnest(m).entity AS entity FROM done"


def _entity_sql(staged: str, key: str, by: str = "") -> str:
    return (
        f"WITH {staged} SELECT {by}entity, CAST(count(*) AS BIGINT) AS n_matches, "
        f"count(DISTINCT {key}) AS n_docs FROM ({_HITS}) GROUP BY {by}entity"
    )


_TOTALS = (
    "count(*) AS n_docs, CAST(sum(CAST(t <> text AS INT)) AS BIGINT) AS n_changed, "
    "CAST(sum(len(m)) AS BIGINT) AS n_matches, "
    "CAST(sum(CAST(t <> text AS INT)) AS DOUBLE) / count(*) AS changed_share"
)

register(
    "entity_report_documents",
    lambda s, d: reports.entity_report(redact(docs(s, d))),
    _entity_sql(duck.staged(DOCUMENTS, "text"), "doc_id"),
)
register(
    "entity_report_messages",
    lambda s, d: reports.entity_report(redact(mails(s, d))),
    _entity_sql(duck.staged(MESSAGES, "text"), "msg_id"),
)
register(
    "entity_report_pages",
    lambda s, d: reports.entity_report(redact(pages(s, d), "html")),
    _entity_sql(duck.staged("SELECT page_id, html FROM pages", "html"), "page_id"),
)
register(
    "entity_report_by_lang",
    lambda s, d: reports.entity_report(redact(docs(s, d)), "lang"),
    _entity_sql(duck.staged(DOCUMENTS, "text"), "doc_id", "lang, "),
)
register(
    "text_report_messages",
    lambda s, d: reports.text_report(redact(mails(s, d)), "msg_id"),
    f"WITH {duck.staged(MESSAGES, 'text')} SELECT msg_id, entity, "
    f"CAST(count(*) AS INT) AS n_matches FROM ({_HITS}) GROUP BY msg_id, entity",
)
for _by in ("lang", "source"):
    register(
        f"report_by_{_by}",
        lambda s, d, by=_by: reports.group_report(redact(docs(s, d)), by),
        f"WITH {duck.staged(DOCUMENTS, 'text')} SELECT {_by}, {_TOTALS} FROM done GROUP BY {_by}",
    )
register(
    "report_by_role",
    lambda s, d: reports.group_report(redact(turns(s, d)), "role"),
    f"WITH {duck.staged('SELECT role, text FROM conversations', 'text')} "
    f"SELECT role, {_TOTALS} FROM done GROUP BY role",
)
register(
    "report_rollup",
    lambda s, d: reports.rollup_report(redact(docs(s, d)), "lang", "source"),
    f"WITH {duck.staged(DOCUMENTS, 'text')} SELECT lang, source, {_TOTALS} FROM done "
    "GROUP BY ROLLUP (lang, source)",
)
register(
    "report_by_quality",
    lambda s, d: reports.group_report(
        redact(docs(s, d).join(table(s, d, "labels"), "doc_id", "left_semi")).select("doc_id", "changed", "n_matches").join(
            table(s, d, "labels"), "doc_id"
        ),
        "quality", "toxic",
    ),
    f"WITH {duck.staged(DOCUMENTS, 'text')} SELECT quality, toxic, {_TOTALS} "
    "FROM done JOIN labels USING (doc_id) GROUP BY quality, toxic",
)
register(
    "riskiest_documents",
    lambda s, d: reports.riskiest(redact(docs(s, d)), "doc_id", 20),
    f"WITH {duck.staged(DOCUMENTS, 'text')} SELECT doc_id, CAST(len(m) AS INT) AS n_matches, "
    "CAST(len(list_distinct(list_transform(m, lambda r: r.entity))) AS INT) AS n_entities "
    "FROM done ORDER BY n_matches DESC, doc_id LIMIT 20",
)


def _summaries_sql(source: str, key: str) -> str:
    return (
        f"WITH {duck.staged(source, 'text')}, parts AS (SELECT {key}, CAST(count(*) AS VARCHAR) "
        f"|| ' ' || entity AS part FROM ({_HITS}) GROUP BY {key}, entity), lines AS (SELECT {key}, "
        f"count(*) AS k, string_agg(part, ', ' ORDER BY part) AS line FROM parts GROUP BY {key}) "
        f"SELECT {key}, CAST(len(m) AS INT) AS n_matches, CAST(coalesce(k, 0) AS INT) AS n_entities, "
        "CASE WHEN t <> text THEN 'Masked ' || len(m) || ' item(s): ' || line "
        f"ELSE '{reports.NOTHING_FOUND}' END AS summary FROM done LEFT JOIN lines USING ({key})"
    )


register(
    "summaries_documents",
    lambda s, d: reports.summaries(redact(docs(s, d)), "doc_id"),
    _summaries_sql(DOCUMENTS, "doc_id"),
)
register(
    "summaries_messages",
    lambda s, d: reports.summaries(redact(mails(s, d)), "msg_id"),
    _summaries_sql(MESSAGES, "msg_id"),
)
_SWITCH = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in TOGGLES.items())
register(
    "rule_counters",
    lambda s, d: reports.rule_counters(redact(mails(s, d), "text", Policy(custom_names=("Kim",)))),
    f"WITH {duck.staged(MESSAGES, 'text', names=['Kim'])} SELECT CASE r.entity {_SWITCH} END AS "
    "switch, count(*) AS n_matches FROM (SELECT unnest(m) AS r FROM done) WHERE r.pass <= 16 "
    "GROUP BY 1",
)
register(
    "corpus_totals",
    lambda s, d: reports.corpus_totals(scan(docs(s, d))),
    f"WITH {duck.staged(DOCUMENTS, 'text')}, found AS (SELECT count(DISTINCT entity) AS k FROM "
    f"({_HITS})) SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM documents "
    "WHERE text IS NULL) AS n_no_text, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, "
    "CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) FILTER (t <> text) AS n_changed, "
    "CAST(sum(len(m)) AS BIGINT) AS n_matches, CAST((SELECT k FROM found) AS INT) AS n_entities "
    "FROM done",
)

# --- Policies --------------------------------------------------------------

# Languages without a row follow the default policy.
_POLICIES = {
    "en": Policy.without("ip_address", custom_names=("the", " ", "Than"), allowlist_tokens=("", "Nine")),
    "de": Policy.only(["email", "phone", "date"]),
    "fr": Policy(enabled=False),
}
_URGENT = {
    "1-URGENT": Policy.without(["phone", "name"], custom_names=("Alice", "Bruno Smith", "Kim")),
    "2-HIGH": Policy.only(["account_like", "iban", "address"]),
    "3-MEDIUM": Policy(enabled=False),
    "4-NOT SPECIFIED": Policy(custom_names=("Order", "parcel"), allowlist_tokens=("Anna", "Jo")),
}


def _policy_sql(source: str, scope: str, policies: dict[str, Policy], keys: str) -> str:
    """Each scope is redacted on its own, under its policy."""
    ctes, parts = [], []
    listed = ", ".join(f"'{v}'" for v in policies)
    for i, (value, policy) in enumerate([*policies.items(), (None, Policy())]):
        if not policy.enabled:
            continue
        where = f"{scope} = '{value}'" if value else f"coalesce({scope} NOT IN ({listed}), true)"
        on = policy.switches()
        ctes.append(duck.staged(
            f"SELECT * FROM ({source}) WHERE {where}", "text",
            on=[e for e in ENTITIES if on[TOGGLES[e]]],
            names=policy.custom_names, tokens=policy.allowlist_tokens, tag=f"_{i}",
        ))
        parts.append(
            f"SELECT {keys}, t AS redacted_text, t <> text AS changed, "
            f"CAST(len(m) AS INT) AS n_matches FROM done_{i}"
        )
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(parts)


register(
    "redact_with_policy_documents",
    lambda s, d: flat(
        redact_with_policy(docs(s, d), policy_table(s, _POLICIES), "lang"), "doc_id", "lang"
    ),
    _policy_sql(DOCUMENTS, "lang", _POLICIES, "doc_id, lang"),
)
register(
    "redact_with_policy_messages",
    lambda s, d: flat(
        redact_with_policy(mails(s, d), policy_table(s, _URGENT), "priority"), "msg_id", "priority"
    ),
    _policy_sql(MESSAGES, "priority", _URGENT, "msg_id, priority"),
)

# One scope holds a third of the rows, 499 others the rest; the table of policies is joined, not broadcast.
_SCOPE = "CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE concat('s', cast(o_custkey % 499 as string)) END"
_HOT = {"hot": Policy.without("phone"), "even": Policy.only(["email", "date", "phone"]), "odd": Policy(custom_names=("Kim",))}


def _hot_scopes(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").select("o_orderkey", F.expr(_SCOPE).alias("scope"))
    scoped = mails(s, d).join(orders, F.col("msg_id") == F.col("o_orderkey")).drop("o_orderkey")
    kinds = policy_table(s, _HOT).withColumnRenamed("scope", "kind")
    scopes = orders.select("scope").distinct().withColumn(
        "kind", F.when(F.col("scope") == "hot", "hot").when(F.substring("scope", 2, 9).cast("int") % 2 == 0, "even").otherwise("odd")
    )
    return flat(redact_with_policy(scoped, scopes.join(F.broadcast(kinds), "kind").drop("kind"), "scope", limit=0), "msg_id", "scope")


def _hot_sql() -> str:
    source = f"SELECT m.*, {_SCOPE} AS scope, {_K_OF} AS kind FROM ({MESSAGES}) m JOIN orders ON o_orderkey = msg_id"
    ctes, parts = [], []
    for i, (kind, policy) in enumerate(_HOT.items()):
        on = policy.switches()
        ctes.append(duck.staged(f"SELECT * FROM ({source}) WHERE kind = '{kind}'", "text", on=[e for e in ENTITIES if on[TOGGLES[e]]], names=policy.custom_names, tag=f"_{i}"))
        parts.append(f"SELECT msg_id, scope, t AS redacted_text, t <> text AS changed, CAST(len(m) AS INT) AS n_matches FROM done_{i}")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(parts)


_K_OF = "CASE WHEN o_orderkey % 3 = 0 THEN 'hot' WHEN o_custkey % 499 % 2 = 0 THEN 'even' ELSE 'odd' END"
register("redact_hot_scopes", _hot_scopes, _hot_sql())

# --- Rules of the caller ---------------------------------------------------

_OWN = (
    own_rule("customer_number", "Customer#[0-9]{9}", "account_like", needs=("Customer#",)),
    own_rule("parcel", r"(parcel )([0-9]+)", "account_like", group=2),
    own_rule("date", r"\bnoon\b", "name"),
    own_rule("gate", r"\bgate|six\b", "alphanumeric", ignore_case=True),
)
#: The same for the SQL: entity, pattern, mask, masked group.
_OWN_SQL = [
    ("customer_number", "Customer#[0-9]{9}", "account_like", 0),
    ("parcel", "parcel ([0-9]+)", "account_like", 1),
    ("date", r"\bnoon\b", "name", 0),
    ("gate", r"(?i)\bgate|six\b", "alphanumeric", 0),
]
register(
    "redact_own_rules",
    lambda s, d: flat(redact(mails(s, d), "text", Policy(custom_names=("Kim",)), _OWN), "msg_id"),
    duck.redacted(MESSAGES, "text", "msg_id", own=_OWN_SQL, names=["Kim"]),
)
register(
    "findings_own_rules",
    lambda s, d: findings(redact(mails(s, d), "text", Policy(custom_names=("Kim",)), _OWN), "msg_id"),
    f"WITH {duck.staged(MESSAGES, 'text', own=_OWN_SQL, names=['Kim'])} " + _FOUND.format(
        key="msg_id", more=', m[i].e AS "end", m[i].e - m[i].s AS matched_len'
    ),
)
# An own entity's switch is off in one scope, that of an own rule for dates goes with the dates.
_OWN_POLICIES = {
    "1-URGENT": Policy(off=frozenset({"redact_own_customer_number", "redact_dates"}), custom_names=("Kim",)),
    "2-HIGH": Policy(off=frozenset({"redact_own_parcel", "redact_own_gate", "redact_phone"})),
    "3-MEDIUM": Policy(enabled=False),
}


def _own_policy_sql() -> str:
    ctes, parts = [], []
    listed = ", ".join(f"'{v}'" for v in _OWN_POLICIES)
    for i, (value, policy) in enumerate([*_OWN_POLICIES.items(), (None, Policy())]):
        if policy.enabled:
            where = f"priority = '{value}'" if value else f"coalesce(priority NOT IN ({listed}), true)"
            switch = {"customer_number": "redact_own_customer_number", "parcel": "redact_own_parcel", "date": "redact_dates", "gate": "redact_own_gate"}
            ctes.append(duck.staged(
                f"SELECT * FROM ({MESSAGES}) WHERE {where}", "text", tag=f"_{i}", names=policy.custom_names,
                on=[e for e in ENTITIES if TOGGLES[e] not in policy.off], own=[x for x in _OWN_SQL if switch[x[0]] not in policy.off],
            ))
            parts.append(f"SELECT msg_id, priority, t AS redacted_text, t <> text AS changed, CAST(len(m) AS INT) AS n_matches FROM done_{i}")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(parts)


register(
    "redact_own_rules_with_policy",
    lambda s, d: flat(
        redact_with_policy(mails(s, d), policy_table(s, _OWN_POLICIES, _OWN), "priority", rules=_OWN), "msg_id", "priority"
    ),
    _own_policy_sql(),
)

# --- Names and tokens ------------------------------------------------------

_NAMES = ("Alice", "Bruno Smith", "Smith", " Kim ", "", "Alice Keller", "Customer#000000007")
_TOKENS = ("", "Anna", "Keller", "St")
register(
    "redact_custom_names",
    lambda s, d: flat(redact(mails(s, d), "text", Policy(custom_names=_NAMES)), "msg_id"),
    duck.redacted(MESSAGES, "text", "msg_id", names=_NAMES),
)
register(
    "redact_name_dictionary",
    lambda s, d: flat(
        redact_names(
            mails(s, d),
            table(s, d, "customer").select(
                (F.col("c_custkey") + 1).alias("ord"), F.col("c_name").alias("name")
            ),
        ),
        "msg_id",
    ),
    # All names have the same form and none overlaps another, so the texts can
    # be cut into names and gaps and each name be looked up.
    f"WITH {duck.staged(MESSAGES, 'text')}, cut AS (SELECT *, "
    "regexp_extract_all(t, '\\bCustomer#[0-9]+\\b') AS h, "
    "string_split_regex(t, '\\bCustomer#[0-9]+\\b') AS g FROM done), "
    "hit AS (SELECT msg_id, h[i] AS name, i FROM (SELECT msg_id, h, unnest(range(1, len(h) + 1)) "
    "AS i FROM cut)), known AS (SELECT msg_id, list(CASE WHEN c_name IS NULL THEN name ELSE "
    "repeat('X', length(name)) END ORDER BY i) AS h, count(c_name) AS k FROM hit LEFT JOIN customer "
    "ON c_name = name GROUP BY msg_id) SELECT msg_id, CASE WHEN known.h IS NULL THEN t ELSE "
    "array_to_string(list_transform(list_zip(g, known.h), lambda z: z[1] || coalesce(z[2], '')), '') "
    "END AS redacted_text, redacted_text <> text AS changed, "
    "CAST(len(m) + coalesce(k, 0) AS INT) AS n_matches FROM cut LEFT JOIN known USING (msg_id)",
)
register(
    "redact_names_joined",
    # As for a table beyond the measured limits: keys and hashes are shuffled, and a salt parts hot keys.
    lambda s, d: flat(
        redact_names(
            mails(s, d),
            table(s, d, "customer").select((F.col("c_custkey") + 1).alias("ord"), F.col("c_name").alias("name")),
            lookup=0, limit=0,
        ),
        "msg_id",
    ),
    SQL["redact_name_dictionary"],
)
register(
    "redact_with_allowlist",
    lambda s, d: flat(redact(mails(s, d), "text", Policy(allowlist_tokens=_TOKENS)), "msg_id"),
    duck.redacted(MESSAGES, "text", "msg_id", tokens=_TOKENS),
)
register(
    "restore_allowlist",
    lambda s, d: restore_allowlist(
        docs(s, d).select("doc_id", F.regexp_replace("text", "[0-9a-e]", "X").alias("text")),
        "text", list(_TOKENS),
    ),
    "SELECT doc_id, replace(replace(replace(regexp_replace(text, '[0-9a-e]', 'X', 'g'), 'XXXX', "
    "'Anna'), 'XXXXXX', 'Keller'), 'XX', 'St') AS text FROM documents",
)

# What a rule finds and is one of these stays: names in letters, an address of the network, a whole date.
_PROTECTED = ("Alice Keller", "Keller", "Smith", "192.168.1.101", "1996-01-02", "Kim", "it's", "a\\b")
register(
    "redact_protected",
    lambda s, d: flat(redact(mails(s, d), "text", Policy(custom_names=("Kim", "Grace"), protected_tokens=_PROTECTED)), "msg_id"),
    duck.redacted(MESSAGES, "text", "msg_id", names=("Kim", "Grace"), protected=_PROTECTED),
)
register(
    "findings_protected",
    lambda s, d: findings(redact(mails(s, d), "text", Policy(custom_names=("Kim", "Grace"), protected_tokens=_PROTECTED)), "msg_id"),
    f"WITH {duck.staged(MESSAGES, 'text', names=('Kim', 'Grace'), protected=_PROTECTED)} " + _FOUND.format(
        key="msg_id", more=', m[i].e AS "end", m[i].e - m[i].s AS matched_len'
    ),
)

# --- Audits ----------------------------------------------------------------


def _rescan_sql(source: str, key: str) -> str:
    again = f"SELECT {key}, t AS once, text <> t AS c, CAST(len(m) AS INT) AS n FROM done"
    return (
        f"WITH {duck.staged(source, 'text')}, {duck.staged(again, 'once', tag='_2')} "
        f"SELECT {key}, c AS changed, n AS n_matches, t <> once AS changed_again, "
        "CAST(len(m) AS INT) AS n_matches_again FROM done_2"
    )


register(
    "rescan_documents",
    lambda s, d: audits.rescan(docs(s, d).select("doc_id", "text")),
    _rescan_sql("SELECT doc_id, text FROM documents", "doc_id"),
)
register(
    "rescan_messages",
    lambda s, d: audits.rescan(mails(s, d).select("msg_id", "text")),
    _rescan_sql(f"SELECT msg_id, text FROM ({MESSAGES})", "msg_id"),
)


def _ablation_sql(source: str, key: str) -> str:
    runs = [("all", "", list(ENTITIES))]
    runs += [("off", e, [x for x in ENTITIES if x != e]) for e in ENTITIES]
    runs += [("only", e, [e]) for e in ENTITIES]
    ctes, parts = [], []
    for i, (mode, rule, on) in enumerate(runs):
        ctes.append(duck.staged(source, "text", on=on, tag=f"_{i}"))
        parts.append(
            f"SELECT '{mode}' AS mode, '{rule}' AS rule, entity, count(*) AS n_matches, "
            f"count(DISTINCT {key}) AS n_docs FROM (SELECT {key}, unnest(m).entity AS entity "
            f"FROM done_{i}) GROUP BY entity"
        )
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(parts)


register(
    "rule_ablation_documents",
    lambda s, d: audits.rule_ablation(docs(s, d)),
    _ablation_sql(DOCUMENTS, "doc_id"),
)
register(
    "rule_ablation_messages",
    lambda s, d: audits.rule_ablation(mails(s, d)),
    _ablation_sql(MESSAGES, "msg_id"),
)

# --- One rule alone, over documents and messages ---------------------------

_CORPUS = (
    "SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL "
    f"SELECT 'message' AS kind, msg_id AS id, text FROM ({MESSAGES})"
)


def corpus(s: SparkSession, d: str) -> DataFrame:
    documents = docs(s, d).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    mail = mails(s, d).select(F.lit("message").alias("kind"), F.col("msg_id").alias("id"), "text")
    return documents.unionByName(mail)


for _entity in ENTITIES:
    register(
        f"only_{_entity}",
        lambda s, d, e=_entity: flat(redact(corpus(s, d), "text", Policy.only(e)), "kind", "id"),
        duck.redacted(_CORPUS, "text", "kind, id", on=[_entity]),
    )

# --- Masks as column functions ---------------------------------------------

# mask: (table, key, Spark SQL and DuckDB expression of the value)
_MASKED = {
    "email": ("supplier", "s_suppkey", "concat(s_name, '@', cast(s_nationkey as string), '@x')"),
    "phone": ("customer", "c_custkey", "concat('+', cast(c_custkey as string), ' (', cast(c_nationkey as string), ')')"),
    "account_like": ("orders", "o_orderkey", "cast(cast(o_orderdate as date) as string)"),
    "address": ("part", "p_partkey", "concat(cast(p_size as string), '  ', p_name, ' ', p_brand, ' 7')"),
    "url_keep_host": ("pages", "page_id", "url"),
    "name": ("customer", "c_custkey", "c_name"),
    "labeled_field": ("part", "p_partkey", "concat(p_type, CASE WHEN p_partkey % 2 = 0 THEN ':  ' ELSE '=' END, p_name)"),
    "alphanumeric": ("nation", "n_nationkey", "concat(n_name, '-', cast(n_regionkey as string))"),
}
for _mask, (_table, _key, _value) in _MASKED.items():
    register(
        f"mask_{_mask}",
        lambda s, d, m=_mask, t=_table, k=_key, v=_value: table(s, d, t)
        .select(k, F.expr(v).alias("value"))
        .select(k, M.MASKS[m]("value").alias("masked")),
        f"SELECT {_key}, {duck.MASKS[_mask]('value')} AS masked FROM "
        f"(SELECT {_key}, {_value} AS value FROM {_table})",
    )

# --- Streams: drained, then read back from their sink -----------------------


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    # A pattern, because a stream takes no path of a single file.
    schema = table(s, d, name).schema
    return jobs.read_text_stream(s, f"{d}/{name}.parquet*", schema)


def _streamed_documents(s: SparkSession, d: str) -> DataFrame:
    base = new_folder(s)
    jobs.start_redaction(_stream(s, d, "documents"), f"{base}/sink", f"{base}/state").awaitTermination()
    return flat(s.read.parquet(f"{base}/sink"), "doc_id")


def _streamed_messages(s: SparkSession, d: str) -> DataFrame:
    base = new_folder(s)
    stream = messages(s, _stream(s, d, "orders"))
    jobs.start_redaction(stream, f"{base}/sink", f"{base}/state").awaitTermination()
    return flat(s.read.parquet(f"{base}/sink"), "msg_id")


def _governed(s: SparkSession, d: str) -> str:
    base = new_folder(s)
    jobs.start_governed_redaction(
        messages(s, _stream(s, d, "orders")), lambda spark: policy_table(spark, _URGENT),
        "priority", f"{base}/sink", f"{base}/state",
    ).awaitTermination()
    return f"{base}/sink"


def _counted(counts: DataFrame) -> DataFrame:
    utc, local = F.lit("UTC"), F.current_timezone()
    return counts.withColumns({
        c: F.convert_timezone(local, utc, F.col(c).cast("timestamp_ntz"))
        for c in ("window_start", "window_end")
    })


def _timed(mails: DataFrame) -> DataFrame:
    # The tables hold times without a zone: take them as UTC, whatever the session's zone.
    ts = F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp")
    return mails.withColumn("ts", ts)


def _windowed(s: SparkSession, d: str) -> DataFrame:
    """The stream gets its rows in six batches that are out of time order."""
    base, orders = new_folder(s), table(s, d, "orders")
    orders.repartition(6, "o_orderkey").write.parquet(f"{base}/orders")
    stream = jobs.read_text_stream(s, f"{base}/orders", orders.schema, maxFilesPerTrigger=1)
    jobs.start_windowed_counts(
        _timed(messages(s, stream)), "ts", f"{base}/sink", f"{base}/state", width="7 days",
    ).awaitTermination()
    counts = s.read.parquet(f"{base}/sink")
    last = counts.agg(F.max("batch").alias("batch"))
    return _counted(counts.join(F.broadcast(last), "batch").drop("batch"))


def _ending(s: SparkSession, d: str) -> DataFrame:
    """Six batches out of time order, windows that end: closed, open and late counts together."""
    base, orders = new_folder(s), table(s, d, "orders")
    orders.repartition(6, "o_orderkey").write.parquet(f"{base}/orders")
    stream = jobs.read_text_stream(s, f"{base}/orders", orders.schema, maxFilesPerTrigger=1)
    jobs.start_ending_windows(
        _timed(messages(s, stream)), "ts", f"{base}/sink", f"{base}/state", width="7 days", delay="30 days",
    ).awaitTermination()
    names = ("window_start", "window_end", "entity", "n_matches")
    parts = [jobs.committed(s, f"{base}/sink", t).select(*names) for t in ("closed", "late")]
    whole = parts[0].unionByName(parts[1]).unionByName(jobs.open_windows(s, f"{base}/sink").select(*names))
    return _counted(whole.groupBy("window_start", "window_end", "entity").agg(F.sum("n_matches").alias("n_matches")))


def _named_stream(s: SparkSession, d: str) -> DataFrame:
    """Messages with all customers' names, from a table that the stream looks at for each batch."""
    base = new_folder(s)
    jobs.start_named_redaction(
        messages(s, _stream(s, d, "orders")),
        lambda spark: table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("ord"), F.col("c_name").alias("name")),
        f"{base}/sink", f"{base}/state",
    ).awaitTermination()
    return flat(jobs.committed(s, f"{base}/sink", "rows"), "msg_id")


register("stream_documents", _streamed_documents, duck.redacted(DOCUMENTS, "text", "doc_id"))
register("stream_messages", _streamed_messages, duck.redacted(MESSAGES, "text", "msg_id"))
register(
    "stream_with_policy",
    lambda s, d: flat(jobs.committed(s, _governed(s, d), "rows"), "msg_id", "priority"),
    _policy_sql(MESSAGES, "priority", _URGENT, "msg_id, priority"),
)
_SCOPED_HITS = _policy_sql(MESSAGES, "priority", _URGENT, "msg_id, priority, m")
register(
    "stream_notices",
    lambda s, d: jobs.committed(s, _governed(s, d), "notices")
    .groupBy("priority", "entity")
    .agg(F.sum("n_matches").alias("n_matches"), F.sum("n_docs").alias("n_docs")),
    "SELECT priority, entity, count(*) AS n_matches, count(DISTINCT msg_id) AS n_docs FROM "
    f"(SELECT priority, msg_id, unnest(m).entity AS entity FROM ({_SCOPED_HITS})) "
    "GROUP BY priority, entity",
)
# Windows 7 days wide, aligned to 1970-01-01.
_WINDOWS = (
    f"WITH {duck.staged(MESSAGES, 'text')}, hits AS (SELECT entity, TIMESTAMP '1970-01-01' + "
    "INTERVAL 7 DAY * CAST(floor(epoch(ts) / 604800) AS INT) AS window_start "
    f"FROM ({_HITS})) SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, entity, "
    "count(*) AS n_matches FROM hits GROUP BY ALL"
)
register("stream_windowed_counts", _windowed, _WINDOWS)
register("stream_ending_windows", _ending, _WINDOWS)
register("stream_with_names", _named_stream, SQL["redact_name_dictionary"])
register(
    "windowed_counts_messages",
    lambda s, d: _counted(jobs.windowed_counts(_timed(mails(s, d)), "ts", "7 days")),
    _WINDOWS,
)


def _read_policies(s: SparkSession, d: str) -> DataFrame:
    """Policies that a JSON table holds, applied to the messages of their scopes."""
    path = new_folder(s)
    policy_table(s, _URGENT).write.json(path)
    found = redact_with_policy(mails(s, d), read_policies(s, path), "priority")
    return flat(found, "msg_id", "priority")


register("redact_with_read_policies", _read_policies, _policy_sql(MESSAGES, "priority", _URGENT, "msg_id, priority"))
