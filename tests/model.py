"""Brute force for the tests: the rules on one string, with the plain patterns."""

from __future__ import annotations

import random

import regex

from checks.patterns import PLAIN


def digits(v):
    return regex.sub("[0-9]", "X", v)


def email(v):
    parts = v.split("@")
    return "X" * max(3, len(parts[0])) + "@" + (parts[1] if len(parts) > 1 else "")


def address(v):
    words = ["X" * len(w) if regex.fullmatch("[0-9]+", w) else "XXXX" for w in v.split()]
    return " ".join(words) or "XXXX"


def url(v):
    head, mark, _ = v.partition("?")
    return head + "?redacted=XXXX" if mark else "https://redacted.local/?redacted=XXXX"


def name(v):
    return "X" * len(v)


def labeled(v):
    key, colon, rest = v.partition(":")
    return key + ":" + rest[: len(rest) - len(rest.lstrip())] + "XXXX" if colon else "XXXX"


def alnum(v):
    return regex.sub(r"[\p{Alphabetic}\p{N}]", "X", v)


PASSES = [
    ("labeled_field", "labeled_field", labeled, 0), ("email", "email", email, 0),
    ("phone_international", "phone", digits, 0), ("phone_parentheses", "phone", digits, 0),
    ("phone_separated", "phone", digits, 0), ("phone_dotted", "phone", digits, 0),
    ("ssn", "ssn", digits, 0), ("url_token", "url_token", url, 0),
    ("account_like", "account_like", digits, 0), ("date", "date", digits, 0),
    ("address", "address", address, 0), ("ip_address", "ip_address", digits, 0),
    ("iban", "iban", alnum, 0), ("passport", "passport", alnum, 0),
    ("salutation", "name", name, 1), ("sign_off", "name", name, 1),
]
COMPILED = {k: regex.compile(p) for k, p in PLAIN.items()}


def one_pass(text, pattern, mask, group):
    out, at, spans = [], 0, []
    for m in pattern.finditer(text):
        out += [text[at : m.start(group)], mask(m.group(group))]
        start = len(text[: m.start(group)].encode())
        spans.append((start, start + len(m.group(group).encode())))
        at = m.end(group)
    return "".join(out) + text[at:], spans


def redact(text, on=None, names=(), tokens=()):
    """(redacted text, [(pass, entity, start, end), ...])"""
    found = []
    for number, (rule, entity, mask, group) in enumerate(PASSES, start=1):
        if on is not None and entity not in on:
            continue
        text, spans = one_pass(text, COMPILED[rule], mask, group)
        found += [(number, entity, s, e) for s, e in spans]
    kept = [n.strip() for n in names if n.strip()]
    for number, n in enumerate(kept, start=17):
        text, spans = one_pass(text, regex.compile(r"\b" + regex.escape(n) + r"\b"), name, 0)
        found += [(number, "name", s, e) for s, e in spans]
    for tok in tokens:
        if tok:
            text = text.replace("X" * len(tok), tok)
    return text, found


PIECES = (
    ["a", "b", "x", "é", "ß", "1", "7", "12", "123", "1234", "2024", "192", "٣", "_", "X", "XXXX"]
    + [" ", " ", " ", "-", ".", ".", "/", ":", "=", "@", ",", "\n", "\n", "\t", "\r\n", "\u00a0",
       "?", "&", "+", "(", ")", "#", "%", ";"]
    + ["password", "Pass", "PIN", "exp", "expiry", "dob", "D.O.B.", "d.o.b", "api key", "apikey",
       "auth-token", "token", "to\u212aen", "pas\u017f", "routing number", "license", "secret"]
    + ["http://", "https://", "HTTP\u017f://", "x.com/", "key=", "session=", "?code=", "&", "sig"]
    + ["a@b.com", "first.last+tag@sub.example.org", "@x.", "com", "co", "555-123-4567",
       "(555) 123-4567", "+1 771", "555.123.4567", "123-45-6789", "123 45 6789", "4111 1111 1111 1111"]
    + ["Main", "Oak Hill", "Street", "st", "ST.", "Ave", "way", "12 Main St", "10.1.12.100", "1.2.34",
       "255", "01/23/1985", "2024-01-15", "GB29", "NWBK", "DE89370400440532013000", "AB12", "WORD"]
    + ["passport", "Passport", "number", "no", "num", "AB1234567", "control"]
    + ["dear", "Hello", "hi", "HEY", "good", "Good", "morning", "evening", "Alice", "Bob", "José",
       "Smith", "Xavier", "best", "Thanks", "thank", "you", "Regards", "warm", "regards", "truly", "yours"]
    + ["192.168.1.100", "255.255.255.255", "300.1.1.1", "Thanks,\n", "Regards\n \n", "best \n,",
       "cheers\r\n", "Dear ", "hi\u00a0", "https://x.com/?auth=", "www.x.org", "Jo\ue000"]
)


def random_text(rng: random.Random, most: int = 14) -> str:
    return "".join(
        rng.choice(PIECES) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, most))
    )
