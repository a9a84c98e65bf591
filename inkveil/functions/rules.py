"""The ordered rule list: one rule is one pass over the text."""

from __future__ import annotations

from dataclasses import dataclass

from inkveil.functions import patterns as P


@dataclass(frozen=True)
class Rule:
    """One pass. ``mask`` names the mask. With ``group`` 2 only the tail of the
    match is masked, and group 1 is the head that stays.

    Three necessary conditions of the pattern save looking for it, and skipping
    a text on them is exact: the text must hold one of the literals of each
    entry of ``needs``, its stretches of numbers must match ``shape``, and it
    must match ``hint``, a cheaper pattern.
    """

    name: str
    entity: str
    toggle: str
    pattern: str
    mask: str
    group: int = 0
    needs: tuple[tuple[str, ...], ...] = ()
    shape: str = ""
    hint: str = ""


# Each pass sees the text that the passes before it have left.
RULES: tuple[Rule, ...] = (
    Rule("labeled_field", "labeled_field", "redact_labeled_fields", P.LABELED_FIELD,
         "labeled_field", needs=((":", "="),), hint=P.LABELED_FIELD_HINT),
    Rule("email", "email", "redact_email", P.EMAIL, "email", group=2,
         needs=(("@",), (".",)), hint=P.EMAIL_HINT),
    Rule("phone_international", "phone", "redact_phone", P.PHONE_INTERNATIONAL, "phone",
         needs=(("+",),), shape=P.PHONE_INTERNATIONAL_SHAPE),
    Rule("phone_parentheses", "phone", "redact_phone", P.PHONE_PARENTHESES, "phone",
         needs=(("(",),), shape=P.PHONE_PARENTHESES_SHAPE),
    Rule("phone_separated", "phone", "redact_phone", P.PHONE_SEPARATED, "phone",
         shape=P.PHONE_SEPARATED_SHAPE),
    Rule("phone_dotted", "phone", "redact_phone", P.PHONE_DOTTED, "phone",
         shape=P.PHONE_DOTTED_SHAPE),
    Rule("ssn", "ssn", "redact_ssn", P.SSN, "account_like", shape=P.SSN_SHAPE),
    Rule("url_token", "url_token", "redact_urls_with_tokens", P.URL_TOKEN,
         "url_keep_host", group=2, needs=(("=",), ("://",))),
    Rule("account_like", "account_like", "redact_account_numbers", P.ACCOUNT,
         "account_like", shape=P.ACCOUNT_SHAPE),
    Rule("date", "date", "redact_dates", P.DATE, "account_like", shape=P.DATE_SHAPE),
    Rule("address", "address", "redact_address", P.ADDRESS, "address", shape=P.ADDRESS_SHAPE),
    Rule("ip_address", "ip_address", "redact_ip_addresses", P.IP_ADDRESS,
         "account_like", shape=P.IP_ADDRESS_SHAPE),
    Rule("iban", "iban", "redact_iban", P.IBAN, "alphanumeric", shape=P.IBAN_SHAPE),
    Rule("passport", "passport", "redact_passport", P.PASSPORT, "alphanumeric"),
    Rule("salutation", "name", "redact_names_in_salutations", P.SALUTATION, "name", group=2,
         hint=P.SALUTATION_HINT),
    Rule("sign_off", "name", "redact_names_in_salutations", P.SIGN_OFF, "name", group=2,
         needs=(("\n",),), hint=P.SIGN_OFF_HINT),
)

# The 12 entities and the switch of each.
ENTITIES = (
    "email", "phone", "address", "url_token", "account_like", "ssn",
    "labeled_field", "date", "name", "ip_address", "iban", "passport",
)
TOGGLES = {
    "email": "redact_email",
    "phone": "redact_phone",
    "address": "redact_address",
    "url_token": "redact_urls_with_tokens",
    "account_like": "redact_account_numbers",
    "ssn": "redact_ssn",
    "labeled_field": "redact_labeled_fields",
    "date": "redact_dates",
    "name": "redact_names_in_salutations",
    "ip_address": "redact_ip_addresses",
    "iban": "redact_iban",
    "passport": "redact_passport",
}
