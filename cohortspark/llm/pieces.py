"""Byte-pair ids of whole texts, from a cache of the pieces that a text is made of.

A match of the pattern never goes on from a character into the space behind it. A text may therefore be cut
before every single space between two other characters, and each piece has the same ids wherever it stands.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

ADJACENT = re.compile(r"\s\s")
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
LONGEST_KEPT = 64


class _Cache(dict):
    """A dict that computes what it lacks, and starts anew when it is full."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class PieceEncoder:
    """encode_word: a match of the pattern to its ids, packed. Both caches have a fixed number of short entries."""

    def __init__(self, pattern: str, encode_word: Callable[[str], bytes], words: int = 600_000, pieces: int = 300_000):
        self.find = regex.compile(pattern).findall
        self.words = _Cache(encode_word, words)
        self.pieces = _Cache(lambda piece: self.plain(" " + piece), pieces)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """The packed ids of a whole text."""
        cut = SINGLE_SPACE.split(text) if ADJACENT.search(text) or text[:1].isspace() else text.split(" ")
        first = self.plain(cut[0])
        return first + b"".join(map(self.pieces.__getitem__, cut[1:])) if len(cut) > 1 else first
