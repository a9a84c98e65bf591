"""The checks' side of the engine: the same passes as staged DuckDB SQL.

One common table expression per pass, with the plain patterns of
``checks.patterns`` and RE2. It shares no code with the library.
"""

from __future__ import annotations

from collections.abc import Iterable

from checks.patterns import PLAIN


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[0-9]', 'X', 'g')"


def _email(v: str) -> str:
    return (
        f"repeat('X', greatest(length(split_part({v}, '@', 1)), 3)) || '@' || "
        f"split_part({v}, '@', 2)"
    )


def _address(v: str) -> str:
    words = f"list_filter(string_split_regex({v}, '\\s+'), lambda w: w <> '')"
    return (
        f"CASE WHEN {v} IS NULL THEN NULL WHEN len({words}) = 0 THEN 'XXXX' ELSE "
        f"array_to_string(list_transform({words}, lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') "
        "THEN repeat('X', length(w)) ELSE 'XXXX' END), ' ') END"
    )


def _url(v: str) -> str:
    return (
        f"CASE WHEN {v} IS NULL THEN NULL WHEN contains({v}, '?') THEN "
        f"split_part({v}, '?', 1) || '?redacted=XXXX' "
        "ELSE 'https://redacted.local/?redacted=XXXX' END"
    )


def _name(v: str) -> str:
    return f"repeat('X', length({v}))"


def _labeled(v: str) -> str:
    return (
        f"CASE WHEN {v} IS NULL THEN NULL WHEN contains({v}, ':') THEN "
        f"regexp_extract({v}, '(?s)^([^:]*:\\s*)', 1) || 'XXXX' ELSE 'XXXX' END"
    )


def _alnum(v: str) -> str:
    return f"regexp_replace({v}, '[\\pL\\pN]', 'X', 'g')"


MASKS = {
    "email": _email, "phone": _digits, "account_like": _digits, "address": _address,
    "url_keep_host": _url, "name": _name, "labeled_field": _labeled, "alphanumeric": _alnum,
}

# (pattern, entity, toggle, mask, masked group)
PASSES = [
    ("labeled_field", "labeled_field", "redact_labeled_fields", _labeled, 0),
    ("email", "email", "redact_email", _email, 0),
    ("phone_international", "phone", "redact_phone", _digits, 0),
    ("phone_parentheses", "phone", "redact_phone", _digits, 0),
    ("phone_separated", "phone", "redact_phone", _digits, 0),
    ("phone_dotted", "phone", "redact_phone", _digits, 0),
    ("ssn", "ssn", "redact_ssn", _digits, 0),
    ("url_token", "url_token", "redact_urls_with_tokens", _url, 0),
    ("account_like", "account_like", "redact_account_numbers", _digits, 0),
    ("date", "date", "redact_dates", _digits, 0),
    ("address", "address", "redact_address", _address, 0),
    ("ip_address", "ip_address", "redact_ip_addresses", _digits, 0),
    ("iban", "iban", "redact_iban", _alnum, 0),
    ("passport", "passport", "redact_passport", _alnum, 0),
    ("salutation", "name", "redact_names_in_salutations", _name, 1),
    ("sign_off", "name", "redact_names_in_salutations", _name, 1),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pass(prev: str, k: str, number: int, pattern: str, entity: str, mask, group: int,
          switch: str = "", protected: str = "") -> list[tuple[str, str]]:
    p = _quoted(pattern)
    ready = f"CASE WHEN {switch} THEN " if switch else ""
    done = " ELSE [] END" if switch else ""
    gaps = f"string_split_regex(t, {p})"
    if group:
        gaps = (
            f"list_transform(list_zip({gaps}, regexp_extract_all(t, {p}, 0), "
            f"regexp_extract_all(t, {p}, 1)), lambda z: z[1] || "
            "coalesce(left(z[2], length(z[2]) - length(z[3])), ''))"
        )
    masked, numbers = mask("z[2]"), "range(1, len(h) + 1)"
    if protected:
        token = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
        masked = f"CASE WHEN list_contains({protected}, {token.format('z[2]')}) THEN z[2] ELSE {masked} END"
        numbers = f"list_filter({numbers}, lambda i: NOT list_contains({protected}, {token.format('h[i]')}))"
    weave = f"list_transform(list_zip(g, h), lambda z: z[1] || coalesce({masked}, ''))"
    start = (
        "list_sum(list_transform(g[:i], lambda x: strlen(x))) + "
        "coalesce(list_sum(list_transform(h[:i-1], lambda x: strlen(x))), 0)"
    )
    records = (
        f"list_transform({numbers}, lambda i: {{'pass': {number}, "
        f"'entity': '{entity}', 's': CAST({start} AS INT), "
        f"'e': CAST({start} + strlen(h[i]) AS INT)}})"
    )
    return [
        (f"h{k}", f"SELECT *, {ready}regexp_extract_all(t, {p}, {group}){done} AS h FROM {prev}"),
        (f"g{k}", f"SELECT *, CASE WHEN len(h) > 0 THEN {gaps} END AS g FROM h{k}"),
        (f"p{k}", (
            "SELECT * EXCLUDE (h, g) REPLACE (CASE WHEN len(h) > 0 THEN array_to_string("
            f"{weave}, '') ELSE t END AS t, CASE WHEN len(h) > 0 THEN "
            f"list_concat(m, {records}) ELSE m END AS m) FROM g{k}"
        )),
    ]


_RECORDS = "CAST([] AS STRUCT(pass INT, entity VARCHAR, s INT, e INT)[])"


def staged(source: str, text: str, *, on: Iterable[str] | None = None, per_row: bool = False,
           names: Iterable[str] = (), tokens: Iterable[str] = (), tag: str = "",
           own: Iterable[tuple[str, str, str, int]] = (), protected: Iterable[str] = ()) -> str:
    """``WITH`` clause whose last table, ``done{tag}``, holds the columns of
    ``source`` plus ``t`` (the redacted text) and ``m`` (the records).

    ``on`` picks entities; ``per_row`` takes the switches from columns; ``own``
    holds rules of the caller as (entity, pattern, mask, masked group).
    """
    own = list(own)
    kept = "[" + ", ".join(map(_quoted, protected)) + "]" if protected else ""
    ctes = [(f"s{tag}", f"SELECT *, {text} AS t, {_RECORDS} AS m FROM ({source}) "
                        f"WHERE {text} IS NOT NULL")]
    for number, (name, entity, toggle, mask, group) in enumerate(PASSES, start=1):
        if on is not None and entity not in set(on):
            continue
        ctes += _pass(ctes[-1][0], f"{tag}_{number}", number, PLAIN[name], entity, mask, group,
                      toggle if per_row else "", kept)
    for i, (entity, pattern, mask, group) in enumerate(own, start=1):
        ctes += _pass(ctes[-1][0], f"{tag}_o{i}", len(PASSES) + i, pattern, entity, MASKS[mask], group, protected=kept)
    for i, name in enumerate([n.strip() for n in names if n.strip()], start=1):
        pattern = r"\b" + "".join(c if c.isalnum() else "\\" + c for c in name) + r"\b"
        ctes += _pass(ctes[-1][0], f"{tag}_n{i}", len(PASSES) + len(own) + i, pattern, "name", _name, 0, protected=kept)
    final = "t"
    for tok in tokens:
        if tok:
            final = f"replace({final}, repeat('X', {len(tok)}), {_quoted(tok)})"
    ctes.append((f"done{tag}", f"SELECT * REPLACE ({final} AS t) FROM {ctes[-1][0]}"))
    return ", ".join(f"{name} AS ({body})" for name, body in ctes)


def redacted(source: str, text: str, keys: str, **options) -> str:
    """SQL of the redacted table: keys, text, changed flag, number of matches."""
    return (
        f"WITH {staged(source, text, **options)} SELECT {keys}, t AS redacted_text, "
        f"t <> {text} AS changed, CAST(len(m) AS INT) AS n_matches FROM done"
    )
