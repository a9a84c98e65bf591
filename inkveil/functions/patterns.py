"""The 16 patterns, for the regular expressions of the JVM.

How they are written:

* ``(?U)`` makes ``\\d \\s \\w \\b`` follow Unicode.
* Case is ignored through explicit letter classes, not through ``(?i)``: the
  JVM flag would also fold the dotted and the dotless Turkish i.
* A cheap look-ahead on the first character stands before ``\\b`` and before
  word lists; it never changes what matches, only how fast other positions fail.
* A ``_HINT`` is a necessary condition of its pattern that starts at a rare
  character. It is checked first, as it costs a fraction of the pattern.
* Runs of blanks are possessive where the next token cannot be a blank, so no
  text makes a pattern backtrack over the same run again and again.
"""

from __future__ import annotations

# Word lists of the rules, in rule order. A blank in a word
# stands for the joint that the rule allows between its parts.
LABELS = [
    "password", "pass", "pin", "cvv", "cvc", "exp", "expiry", "expiration",
    "dob", "license", "licence", "api key", "secret", "token", "auth token",
    "access key", "private key", "routing number",
]
URL_KEYS = [
    "token", "apikey", "api_key", "api-key", "auth", "session", "key", "sig",
    "signature", "code", "secret", "password", "access_token", "refresh_token",
]
STREET_TYPES = [
    "street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd",
    "drive", "dr", "lane", "ln", "way", "court", "ct", "place", "pl",
    "circle", "cir", "terrace", "ter", "parkway", "pkwy", "highway", "hwy",
]
GREETINGS = [
    "dear", "hello", "hi", "hey",
    "good morning", "good afternoon", "good evening",
]
SIGN_OFFS = [
    "best", "thanks", "thank you", "regards", "sincerely", "cheers",
    "warm regards", "kind regards", "yours truly", "respectfully",
]
PASSPORT_MARKS = ["no", "number", "#", "num"]

# The two characters outside ASCII that fold to a letter of it.
EXTRA_FOLDS = {"k": "\\u212A", "s": "\\u017F"}
LETTERS = "a-zA-Z" + EXTRA_FOLDS["s"] + EXTRA_FOLDS["k"]


def any_case(word: str, joint: str = " ") -> str:
    """A word as a pattern that ignores case; blanks become ``joint``."""
    out = []
    for ch in word:
        if ch == " ":
            out.append(joint)
        elif ch.isalpha():
            out.append(f"[{ch}{ch.upper()}{EXTRA_FOLDS.get(ch, '')}]")
        else:
            out.append("\\" + ch if ch in ".-" else ch)
    return "".join(out)


def first_letters(words: list[str]) -> str:
    """Look-ahead on the letters that the words begin with."""
    letters = sorted({w[0] for w in words})
    return "(?=[" + "".join(any_case(c)[1:-1] for c in letters) + "])"


def last_letters(words: list[str], n: int) -> str:
    """The n letters that each word ends with; its last part, if that is shorter."""
    ends = sorted({w.split()[-1][-n:] for w in words})
    return "(?:" + "|".join(any_case(e) for e in ends) + ")"


def one_of(words: list[str], joint: str = " ") -> str:
    """One of the words, tried by first letter."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(
        any_case(first) + "(?:" + "|".join(any_case(rest, joint) for rest in rests) + ")"
        for first, rests in by_first.items()
    ) + ")"


_LABEL = "(?:" + "|".join(
    [any_case(w, r"[_\- ]?") for w in LABELS] + [r"[dD]\.?[oO]\.?[bB]\.?"]
) + ")"
LABELED_FIELD = (
    "(?U)" + first_letters(LABELS) + r"\b" + _LABEL + r"\s*+[:=]\s*+\S++"
)
# The end of a label and up to two blanks, or more blanks, before the sign.
_LABEL_END = last_letters(LABELS, 5)[:-1] + r"|[oO]\.?[bB]\.?)"
LABELED_FIELD_HINT = rf"(?U)[:=](?<=(?:{_LABEL_END}\s{{0,2}}|\s{{3}})[:=])\s*+\S"

# The address starts at the first word boundary of a run of local-part
# characters. Entering each run once, at its start or where the last match
# ended, keeps long runs without "@" linear. Group 1 is the skipped head, group
# 2 the address.
_LOCAL = f"[{LETTERS}0-9._%+\\-]"
EMAIL = (
    rf"(?U)(?:\G|(?<!{_LOCAL}))((?>{_LOCAL}*?\b))"
    rf"({_LOCAL}++@[{LETTERS}0-9.\-]+\.[{LETTERS}]{{2,}}\b)"
)

EMAIL_HINT = rf"@(?<={_LOCAL}@)[{LETTERS}0-9.\-]"

# The stretches of a text that rules about numbers can match in: a digit and
# the digits, blanks and separators after it. A ``_SHAPE`` is a necessary
# condition of its pattern on these stretches alone, which are far shorter
# than the text. Masks only ever take digits away.
NUMBERS = r"(?U)\d[\d\s()./\-]*+"

PHONE_INTERNATIONAL = (
    r"(?U)\+\d{1,3}[ \-]?\(?\d{2,4}\)?[ \-]?\d{3,4}[ \-]?\d{3,4}\b"
)
PHONE_INTERNATIONAL_SHAPE = r"(?U)\d{2}\)?[ \-]?\d{3,4}[ \-]?\d{3}"
PHONE_PARENTHESES = r"(?U)\(\d{3}\)\s*+\d{3}[ \-]?\d{4}\b"
PHONE_PARENTHESES_SHAPE = r"(?U)\d{3}\)\s*+\d{3}[ \-]?\d{4}"
PHONE_SEPARATED = r"(?U)(?=\d)\b\d{3}[ \-]\d{3}[ \-]\d{4}\b"
PHONE_SEPARATED_SHAPE = r"(?U)\d{3}[ \-]\d{3}[ \-]\d{4}"
PHONE_DOTTED = r"(?U)(?=\d)\b\d{3}\.\d{3}\.\d{4}\b"
PHONE_DOTTED_SHAPE = r"(?U)\d{3}\.\d{3}\.\d{4}"

SSN = r"(?U)(?=\d)\b\d{3}[\- ]\d{2}[\- ]\d{4}\b"
SSN_SHAPE = r"(?U)\d{3}[\- ]\d{2}[\- ]\d{4}"

# A URL match always runs to the next blank, so a run without blanks holds at
# most one: each run is entered once and group 2 starts at its first "http".
_HTTP = any_case("http") + any_case("s") + "?://"
URL_TOKEN = (
    rf"(?U)(?<!\S)(?=[^\s:]*+:)((?>\S*?(?={_HTTP})\b))"
    rf"({_HTTP}\S+{one_of(URL_KEYS)}=[^\s&]+\S*)"
)

ACCOUNT = r"(?U)(?=\d)\b(?:\d[ \-]?){10,19}\b"
ACCOUNT_SHAPE = r"(?U)(?:\d[ \-]?){10}"

DATE = (
    r"(?U)(?=\d)\b(?:\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"
    r"|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2})\b"
)
DATE_SHAPE = r"(?U)\d[/\-.]\d{1,2}[/\-.]\d"

ADDRESS = (
    rf"(?U)(?=\d)\b\d{{1,6}}\s++[{LETTERS}0-9][{LETTERS}0-9.\- ]{{2,40}}\s"
    rf"{first_letters(STREET_TYPES)}{one_of(STREET_TYPES)}\b[^\n,]{{0,40}}"
)
ADDRESS_SHAPE = r"(?U)\d\s"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IP_ADDRESS = rf"(?U)(?=[0-9])\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
IP_ADDRESS_SHAPE = r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"

IBAN = (
    r"(?U)(?=[A-Z]{2}\d)\b[A-Z]{2}\d{2} ?[A-Z0-9]{4}(?: ?[A-Z0-9]{4}){1,7}"
    r"(?: ?[A-Z0-9]{1,4})?\b"
)
IBAN_SHAPE = r"(?U)\d{2}"

PASSPORT = (
    rf"(?U){any_case('passport')}\s*+{one_of(PASSPORT_MARKS)}?\s*+[:=]?\s*+"
    rf"[{LETTERS}0-9]{{6,12}}"
)

# Only the name, group 2, is masked; it always ends where the match ends.
_NAME = r"([A-Z][a-z]{1,30}(?:\s++[A-Z][a-z]{1,30})?)"
SALUTATION = rf"(?U)({first_letters(GREETINGS)}{one_of(GREETINGS, r'\s++')}\s++){_NAME}\b"
SALUTATION_HINT = (
    rf"(?U)[A-Z](?<=(?:{last_letters(GREETINGS, 3)}\s{{1,2}}|\s{{3}})[A-Z])[a-z]"
)
SIGN_OFF = (
    rf"(?U)({first_letters(SIGN_OFFS)}{one_of(SIGN_OFFS, r'\s++')}"
    rf"(?:\s*+,)?(?=[^\S\n]*+\n)\s*+){_NAME}"
)
# The first line end after the sign-off: right behind it, or behind a blank.
SIGN_OFF_HINT = (
    rf"(?U)\n(?:(?<=(?:{last_letters(SIGN_OFFS, 3)}|,)\r?\n)\s*+[A-Z][a-z]"
    r"|(?<=(?:[^\S\r\n]|\s\r)\n))"
)
