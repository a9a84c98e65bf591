"""The eight masks.

Each is a built-in SQL expression over a string, so it serves on its own for
structured columns as well: ``df.select(mask_name("c_name"))``. The argument is
a column name or any other SQL expression; NULL stays NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.expressions import let

# The mask letter, the word mask, the shortest local part of a
# masked address, and what is left of a URL.
MARK = "X"
WORD_MASK = "XXXX"
MIN_LOCAL_PART = 3
URL_TAIL = "?redacted=XXXX"
URL_WITHOUT_QUERY = "https://redacted.local/?redacted=XXXX"


def _email(v: str) -> str:
    local = f"split_part({v}, '@', 1)"
    width = f"greatest(char_length({local}), {MIN_LOCAL_PART})"
    return f"concat(repeat('{MARK}', {width}), '@', split_part({v}, '@', 2))"


def _digits(v: str) -> str:
    return f"translate({v}, '0123456789', '{MARK * 10}')"


def _address(v: str) -> str:
    words = rf"filter(split({v}, r'(?U)\s+'), w -> w <> '')"
    masked = (
        f"transform(words, w -> if(w RLIKE '^[0-9]+$', "
        f"repeat('{MARK}', char_length(w)), '{WORD_MASK}'))"
    )
    return let("words", words, (
        f"CASE WHEN size(words) > 0 THEN array_join({masked}, ' ') "
        f"WHEN words IS NOT NULL THEN '{WORD_MASK}' END"
    ))


def _url_keep_host(v: str) -> str:
    return (
        f"CASE WHEN contains({v}, '?') THEN concat(substring_index({v}, '?', 1), '{URL_TAIL}') "
        f"WHEN {v} IS NOT NULL THEN '{URL_WITHOUT_QUERY}' END"
    )


def _name(v: str) -> str:
    return f"repeat('{MARK}', char_length({v}))"


def _labeled_field(v: str) -> str:
    label = rf"regexp_extract({v}, r'(?Us)^([^:]*:\s*)', 1)"
    return (
        f"CASE WHEN contains({v}, ':') THEN concat({label}, '{WORD_MASK}') "
        f"WHEN {v} IS NOT NULL THEN '{WORD_MASK}' END"
    )


def _alphanumeric(v: str) -> str:
    return rf"regexp_replace({v}, r'[\p{{IsAlphabetic}}\p{{N}}]', '{MARK}')"


# The masks as SQL text over an expression, by name.
MASK_SQL: dict[str, Callable[[str], str]] = {
    "email": _email,
    "phone": _digits,
    "account_like": _digits,
    "address": _address,
    "url_keep_host": _url_keep_host,
    "name": _name,
    "labeled_field": _labeled_field,
    "alphanumeric": _alphanumeric,
}


def mask_email(value: str) -> Column:
    """Hide the local part, keep the domain."""
    return F.expr(_email(value))


def mask_phone(value: str) -> Column:
    """Hide the ASCII digits, keep the separators."""
    return F.expr(_digits(value))


def mask_account_like(value: str) -> Column:
    """Hide the ASCII digits, keep the separators."""
    return F.expr(_digits(value))


def mask_address(value: str) -> Column:
    """Hide every word; numbers keep their length, blanks collapse to one."""
    return F.expr(_address(value))


def mask_url_keep_host(value: str) -> Column:
    """Keep a URL up to its query string."""
    return F.expr(_url_keep_host(value))


def mask_name(value: str) -> Column:
    """Hide every character, blanks included."""
    return F.expr(_name(value))


def mask_labeled_field(value: str) -> Column:
    """Keep the label up to the first colon and the blanks after it."""
    return F.expr(_labeled_field(value))


def mask_alphanumeric(value: str) -> Column:
    """Hide the letters and numbers of any script, keep the rest."""
    return F.expr(_alphanumeric(value))


MASKS: dict[str, Callable[[str], Column]] = {
    "email": mask_email,
    "phone": mask_phone,
    "account_like": mask_account_like,
    "address": mask_address,
    "url_keep_host": mask_url_keep_host,
    "name": mask_name,
    "labeled_field": mask_labeled_field,
    "alphanumeric": mask_alphanumeric,
}
