"""Splits text for a byte-level BPE with the usual pattern, word by word and from memory."""

from __future__ import annotations

import struct
from collections.abc import Callable

import regex

#: Entries and length of an entry that a memory keeps. It is emptied when full, so a task's memory has a bound.
ENTRIES, LONGEST = 120_000, 64


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Memory(dict):
    """Remembers a function of short strings."""

    def __init__(self, function: Callable[[str], bytes], entries: int = ENTRIES) -> None:
        super().__init__()
        self.function, self.entries = function, entries

    def __missing__(self, key: str) -> bytes:
        value = self.function(key)
        if len(key) <= LONGEST:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


class NotApart(Exception):
    """A blank that no border of tokens can be told from alone."""


class Units:
    """Encodes texts piece by piece, a piece being a match of the pattern.

    No match of the pattern holds a blank anywhere but at its start or in a run
    of white space. So a blank before a character that is not white space always
    starts a match, and what lies between two such blanks is split alike
    wherever it stands: such words are remembered with their encoding. Texts
    with other runs of blanks are split whole.
    """

    def __init__(self, pattern: str, encode: Callable[[str], bytes], entries: int = ENTRIES) -> None:
        self.pattern, self.pieces, self.words = regex.compile(pattern), Memory(encode, entries), Memory(self._word, entries)

    def _word(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise NotApart
        return self._text(" " + word)

    def _text(self, text: str) -> bytes:
        return b"".join([self.pieces[x] for x in self.pattern.findall(text)])

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            words = [self.words[x] for x in rest]
        except NotApart:
            return self._text(text)
        return b"".join([self._text(first), *words])
