"""Rules of the caller: a pattern that is safe to run on any text becomes a pass like the others.

The JVM's engine backtracks, so a careless pattern can take quadratic or
exponential time on one hostile text and hold up a whole job. A pattern is
therefore parsed and compiled:

* A run of one kind of character is made possessive where that changes no
  match: where what comes next can't be a character of the run, or nothing does.
* An unbounded repetition must then be such a run, possessive, and the character
  before it must not be one of its own; so no run is read more than once.
* Repetitions with a bound may backtrack, but not in more than ``MOST_WAYS`` ways.

What does not meet this, and syntax that this module does not know
(back-references, ``\\p``, lazy or nested unbounded repetitions), is refused.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from inkveil.functions.masks import MASK_SQL
from inkveil.functions.rules import ENTITIES, TOGGLES, Rule

#: Ways in which the bounded repetitions of a pattern may be tried from one place.
MOST_WAYS = 256
#: Longest repetition that counts as bounded.
MOST_TIMES = 1_000
OWN = "redact_own_"


class UnsafePattern(ValueError):
    """A pattern that could take more than linear time, or that can't be understood."""


# Characters: a bit for each one of ASCII, and kinds for the others. Kinds are
# told coarsely, so sets may seem to meet that do not, but never the other way.

KINDS = frozenset({"word", "digit", "space", "other"})


def kind_of(char: str) -> str:
    category = unicodedata.category(char)
    if category == "Nd":
        return "digit"
    if category[0] in "LM" or category in ("Nl", "Pc", "So", "Cf"):
        return "word"
    return "space" if char.isspace() else "other"


@dataclass(frozen=True)
class Chars:
    ascii: int = 0
    others: frozenset[str] = frozenset()

    @classmethod
    def of(cls, text: str) -> Chars:
        return cls(sum({1 << ord(c) for c in text if c < "\x80"}), frozenset(kind_of(c) for c in text if c >= "\x80"))

    def __or__(self, other: Chars) -> Chars:
        return Chars(self.ascii | other.ascii, self.others | other.others)

    def inverted(self, exact: bool) -> Chars:
        """All others; unless ``exact``, a kind that is only partly in stays."""
        return Chars(ALL.ascii & ~self.ascii, KINDS - self.others if exact else KINDS)

    def meets(self, other: Chars) -> bool:
        return bool(self.ascii & other.ascii or self.others & other.others)

    def within(self, other: Chars) -> bool:
        return not self.ascii & ~other.ascii and self.others <= other.others


ALL = Chars((1 << 128) - 1, KINDS)
DIGIT = Chars(Chars.of("0123456789").ascii, frozenset({"digit"}))
WORD = Chars(Chars.of("_0123456789" + "".join(chr(k) + chr(k + 32) for k in range(65, 91))).ascii, frozenset({"word", "digit"}))
SPACE = Chars(Chars.of(" \t\n\v\f\r").ascii, frozenset({"space"}))
CLASSES = {"d": DIGIT, "w": WORD, "s": SPACE, "D": DIGIT.inverted(True), "W": WORD.inverted(True), "S": SPACE.inverted(True)}
CONTROLS = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


@dataclass
class Node:
    """``chars`` consumes one character; ``mark`` consumes none; ``group`` holds alternatives; ``many`` repeats its one part."""

    kind: str
    text: str = ""
    chars: Chars = field(default_factory=Chars)
    parts: list = field(default_factory=list)
    low: int = 1
    high: int | None = 1
    mode: str = ""

    def emit(self) -> str:
        if self.kind == "group":
            return self.text + "|".join("".join(x.emit() for x in part) for part in self.parts) + ")"
        if self.kind == "many":
            return self.parts[0].emit() + self.text + self.mode
        return self.text


class _Parser:
    def __init__(self, text: str, ignore_case: bool) -> None:
        self.text, self.at, self.ignore_case = text, 0, ignore_case

    def fail(self, what: str) -> UnsafePattern:
        return UnsafePattern(f"{what} at place {self.at} of {self.text!r}")

    def parsed(self) -> list[list[Node]]:
        parts = self.alternatives()
        if self.at < len(self.text):
            raise self.fail("a bracket too many")
        return parts

    def alternatives(self) -> list[list[Node]]:
        parts: list[list[Node]] = [[]]
        while self.at < len(self.text) and self.text[self.at] != ")":
            if self.text[self.at] == "|":
                self.at += 1
                parts.append([])
            else:
                parts[-1].append(self.repeated(self.atom()))
        return parts

    def repeated(self, node: Node) -> Node:
        m = re.compile(r"[?*+]|\{(\d+)(,(\d*))?\}").match(self.text, self.at)
        if m is None:
            if self.text[self.at : self.at + 1] == "{":
                raise self.fail("a brace that is no repetition")
            return node
        if node.kind == "mark":
            raise self.fail("a repetition of nothing")
        self.at = m.end()
        mode = self.text[self.at : self.at + 1]
        mode = mode if mode and mode in "?+" else ""
        self.at += len(mode)
        if m[1]:
            low, high = int(m[1]), int(m[1]) if m[2] is None else int(m[3]) if m[3] else None
        else:
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[m[0]]
        if self.text[self.at : self.at + 1] and self.text[self.at] in "?*+{":
            raise self.fail("a repetition of a repetition")
        return Node("many", m[0], parts=[node], low=low, high=high, mode=mode)

    def literal(self, char: str, text: str = "") -> Node:
        both = {char, char.lower(), char.upper()} if self.ignore_case else {char}
        both = {c for c in both if len(c) == 1}
        if len(both) > 1:
            return Node("chars", "[" + "".join(sorted(both)) + "]", Chars.of("".join(both)))
        return Node("chars", text or char.replace("'", r"\x27"), Chars.of(char))

    def escaped(self) -> tuple[str, Chars, str]:
        """(text, characters, the one character if it is one) of an escape."""
        m = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|(.))", re.DOTALL).match(self.text, self.at)
        if m is None:
            raise self.fail("a broken escape")
        self.at = m.end()
        if m[1] or m[2]:
            char = chr(int(m[1] or m[2], 16))
        elif m[3] in CLASSES:
            return m[0], CLASSES[m[3]], ""
        elif m[3] in CONTROLS:
            char = CONTROLS[m[3]]
        elif m[3].isalnum():
            raise self.fail(f"an unknown escape {m[0]!r} before")
        else:
            char = m[3]
        return (r"\x27" if char == "'" else m[0]), Chars.of(char), char

    def atom(self) -> Node:
        char = self.text[self.at]
        if char == "\\":
            if self.text[self.at : self.at + 2] in (r"\b", r"\B", r"\z"):
                self.at += 2
                return Node("mark", self.text[self.at - 2 : self.at])
            text, chars, one = self.escaped()
            return self.literal(one, text) if one else Node("chars", text, chars)
        if char == "[":
            return self.class_()
        if char == "(":
            return self.group()
        self.at += 1
        if char == ".":
            return Node("chars", ".", Chars.of("\n\r").inverted(False))
        if char in "^$":
            return Node("mark", char)
        if char in "?*+{":
            raise self.fail("a repetition of nothing before")
        return self.literal(char)

    def class_(self) -> Node:
        begun = self.at
        inverted = self.text.startswith("[^", begun)
        self.at += 1 + inverted
        pieces: list[str] = []
        chars, exact = Chars(), True
        while self.text[self.at : self.at + 1] != "]" or not pieces:
            if self.at >= len(self.text) or self.text[self.at] == "[" or self.text.startswith("&&", self.at):
                raise self.fail("a class that does not end, or one inside another,")
            text, more, low = self.member()
            if low and self.text[self.at : self.at + 1] == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                end, _, high = self.member()
                if not high or high < low:
                    raise self.fail("a broken range")
                text += "-" + end
                more = Chars(Chars.of("".join(map(chr, range(ord(low), min(ord(high), 127) + 1)))).ascii, KINDS if high >= "\x80" else frozenset())
            exact = exact and (not more.others or not low)
            pieces.append(text)
            chars |= more
        self.at += 1
        if self.ignore_case:
            letters = [chr(k) for k in range(128) if chars.ascii >> k & 1 and chr(k).isalpha()]
            missing = {c.swapcase() for c in letters} - set(letters)
            pieces += sorted(missing)
            chars |= Chars.of("".join(missing))
        return Node("chars", "[" + "^" * inverted + "".join(pieces) + "]", chars.inverted(exact) if inverted else chars)

    def member(self) -> tuple[str, Chars, str]:
        """(text, characters, the one character if it is one) of a class's next member."""
        if self.text[self.at] == "\\":
            return self.escaped()
        char = self.text[self.at]
        self.at += 1
        return (r"\x27" if char == "'" else "\\" + char if char in "^-]&" else char), Chars.of(char), char

    def group(self) -> Node:
        m = re.compile(r"\((?:\?(?::|=|!|<=|<!|>))?").match(self.text, self.at)
        if self.text.startswith("(?", self.at) and len(m[0]) == 1:
            raise self.fail("an unknown group")
        self.at = m.end()
        parts = self.alternatives()
        if self.text[self.at : self.at + 1] != ")":
            raise self.fail("a bracket too few")
        self.at += 1
        node = Node("group", m[0], parts=parts)
        if m[0] in ("(", "(?:"):
            return node
        if any(x.kind in ("group", "many") for part in parts for x in part):
            raise self.fail("a look-around that holds more than characters before")
        return Node("mark", node.emit(), parts=parts)


# What may come next: characters, whether the pattern may end there, whether a mark stands before them.
Next = tuple[Chars, bool, bool]


def _starts(items: list[Node], after: Next) -> Next:
    for item in reversed(items):
        if item.kind == "chars":
            after = item.chars, False, False
        elif item.kind == "mark":
            after = after[0], after[1], True
        else:
            inner = [_starts(part, after) for part in (item.parts if item.kind == "group" else [item.parts])]
            if item.kind == "many" and item.low == 0:
                inner.append(after)
            chars = Chars()
            for x in inner:
                chars |= x[0]
            after = chars, any(x[1] for x in inner), any(x[2] for x in inner)
    return after


Apart = Callable[[Chars], bool]


def _apart_before(items: list[Node], before: Apart) -> Apart:
    """Of what follows ``items``: whether the character before it is surely none of a set."""
    seen = Chars()
    for k, item in reversed(list(enumerate(items))):
        if item.kind == "group":
            ends = [_apart_before(part, _apart_before(items[:k], before)) for part in item.parts]
            return lambda run, seen=seen: not run.meets(seen) and all(x(run) for x in ends)
        if item.kind == "mark":
            if item.text == r"\b":
                return lambda run, seen=seen: run.within(WORD) and not run.meets(seen)
            if item.text.startswith("(?<!") and len(item.parts) == 1 and len(item.parts[0]) == 1 and item.parts[0][0].kind == "chars":
                return lambda run, seen=seen, no=item.parts[0][0].chars: run.within(no) and not run.meets(seen)
            continue
        body = item.parts[0] if item.kind == "many" else item
        if body.kind != "chars":
            return lambda run: False
        seen |= body.chars
        if item.kind == "chars" or item.low > 0:
            return lambda run, seen=seen: not run.meets(seen)
    return lambda run, seen=seen: before(run) and not run.meets(seen)


def _settle(items: list[Node], before: Apart, after: Next) -> int:
    """Make runs possessive where that changes nothing, refuse what stays unsafe; the number of ways to try the rest."""
    ways = 1
    for k, item in enumerate(items):
        follows = _starts(items[k + 1 :], after)
        ahead = _apart_before(items[:k], before)
        if item.kind == "group":
            ways *= max(1, sum(_settle(part, ahead, follows) for part in item.parts))
        elif item.kind == "many":
            body = item.parts[0]
            long = item.high is None or item.high > MOST_TIMES
            if body.kind == "chars":
                if item.mode == "" and not follows[2] and not follows[0].meets(body.chars):
                    item.mode = "+"
                if long and item.mode != "+":
                    raise UnsafePattern(f"{item.emit()!r} may give back what it has read: bound it, or let a character that it does not hold follow")
                if long and not ahead(body.chars):
                    raise UnsafePattern(f"{item.emit()!r} may be read again from each of its characters: bound it, or put \\b or a character that it does not hold before it")
                if item.mode != "+":
                    ways *= item.high - item.low + 1
            else:
                if long:
                    raise UnsafePattern(f"{item.emit()!r} repeats a group without a bound")
                own = _settle_group(body, item, ahead, follows)
                ways *= min(own**item.high * (item.high - item.low + 1), MOST_WAYS + 1)
        if ways > MOST_WAYS:
            raise UnsafePattern(f"{''.join(x.emit() for x in items)!r} can be tried in more than {MOST_WAYS} ways")
    return ways


def _settle_group(body: Node, item: Node, ahead: Apart, follows: Next) -> int:
    """The group may come again, so what follows it, and what stands before it, may be itself."""
    again = [_starts(part, follows) for part in body.parts]
    chars, ends, marked = follows
    for x in again:
        chars, ends, marked = chars | x[0], ends or x[1], marked or x[2]
    before = ahead if item.high == 1 else (lambda run: False)
    return max(1, sum(_settle(part, before, (chars, ends, marked)) for part in body.parts))


def compiled(pattern: str, ignore_case: bool = False) -> str:
    """The pattern as the passes take it: classes follow Unicode, runs are possessive; raises ``UnsafePattern``."""
    parts = _Parser(pattern, ignore_case).parsed()
    top = Node("group", "(?:", parts=parts)
    nothing: Next = (Chars(), True, False)
    if any(_empty(part) for part in parts):
        raise UnsafePattern(f"{pattern!r} matches the empty text")
    total = sum(_settle(part, lambda run: False, nothing) for part in parts)
    if total > MOST_WAYS:
        raise UnsafePattern(f"{pattern!r} can be tried in more than {MOST_WAYS} ways")
    return "(?U)" + (top.emit() if len(parts) > 1 else "".join(x.emit() for x in parts[0]))


def _empty(items: list[Node]) -> bool:
    """Whether a sequence can match without reading anything."""
    return all(
        x.kind == "mark" or x.kind == "group" and any(map(_empty, x.parts)) or x.kind == "many" and (x.low == 0 or _empty(x.parts)) for x in items
    )


def _two_groups(pattern: str) -> bool:
    """Whether a pattern is just a head in group 1 and a tail in group 2, with marks around."""
    parts = _Parser(pattern, False).parsed()

    def count(items: list[Node]) -> int:
        return sum((x.text == "(") * (x.kind == "group") + sum(count(p if x.kind == "group" else [p]) for p in x.parts if x.kind in ("group", "many")) for x in items)

    if len(parts) != 1:
        return False
    kept = [x for x in parts[0] if x.kind != "mark"]
    return len(kept) == 2 and all(x.kind == "group" and x.text == "(" for x in kept) and count(parts[0]) == 2


def own_rule(entity: str, pattern: str, mask: str = "name", group: int = 0, needs: tuple[str, ...] = (), ignore_case: bool = False, name: str = "") -> Rule:
    """A rule of the caller.

    ``entity`` is one of the library's, whose switch then holds for the rule, or
    a new one with the switch ``redact_own_<entity>``. ``mask`` names one of the
    eight masks. With ``group=2`` the pattern is ``(head)(tail)`` and only the
    tail is masked. A text without any of the literals ``needs`` is not searched.
    Matches are those of the pattern as given, classes following Unicode.
    """
    if not re.fullmatch(r"[a-z][a-z0-9_]*", entity):
        raise ValueError(f"no name for an entity: {entity!r}")
    if mask not in MASK_SQL:
        raise ValueError(f"unknown mask {mask!r}; there are {sorted(MASK_SQL)}")
    if group not in (0, 2):
        raise ValueError("group is 0 for the whole match or 2 for its tail")
    if group and not _two_groups(pattern):
        raise ValueError("with group=2 the pattern must be (head)(tail)")
    if any("'" in x or "\\" in x or not x for x in needs):
        raise ValueError("needed literals hold neither quotes nor backslashes and are not empty")
    switch = TOGGLES[entity] if entity in ENTITIES else OWN + entity
    return Rule(name or f"own_{entity}", entity, switch, compiled(pattern, ignore_case), mask, group, needs=(tuple(needs),) if needs else ())


def own_switches(rules: tuple[Rule, ...]) -> tuple[str, ...]:
    """The switches that rules of the caller add, in order."""
    return tuple(dict.fromkeys(r.toggle for r in rules if r.toggle.startswith(OWN)))


def renamed(rule: Rule, name: str) -> Rule:
    """The same rule under another name."""
    return replace(rule, name=name)
