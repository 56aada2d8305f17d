"""Cutting a text into pieces that byte-level BPE encodes independently.

The split pattern of the public vocabularies never lets a match cross from a
visible character into a following space, and a single space between visible
characters always opens a new match. A text whose spaces all stand alone can so
be cut at its spaces: each piece is encoded by itself (with its leading space),
and pieces repeat often enough for a cache. Other texts take the pattern itself.
"""

from __future__ import annotations

import re

#: A space beside other white space: the cut at single spaces isn't safe then.
#: ``re`` counts at least the characters as white space that the pattern does.
_RUN = re.compile(r" \s|\s ")


class PieceEncoder:
    """Encodes texts through a cache of space-led pieces.

    ``encode_match(match) -> value`` encodes one match of the pattern; ``join``
    puts a list of values together. ``special`` maps strings to their values
    that are cut out of the text first, as the library does with special tokens.
    """

    def __init__(self, encode_match, join, special: dict | None = None, limit: int = 200_000, match_limit: int = 20_000):
        import public_tokenizers
        import regex

        from .common import GenerationCache

        self._find = regex.compile(public_tokenizers.PATTERN).findall
        self._join, self._special, self._encode_match = join, special or {}, encode_match
        self.matches = GenerationCache(encode_match, match_limit)
        self.pieces = GenerationCache(self._piece, limit)
        self._cut = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None

    def _by_pattern(self, text: str):
        return self._join([self.matches[m] for m in self._find(text)])

    def _piece(self, piece: str):
        found = self._find(" " + piece)
        if len(found) == 1:  # the cache of pieces holds it already
            value = self.matches.get(found[0])
            return self._encode_match(found[0]) if value is None else value
        return self._join([self.matches[m] for m in found])

    def _plain(self, text: str):
        if _RUN.search(text):
            return self._by_pattern(text)
        first, *rest = text.split(" ")
        head = self._by_pattern(first)
        return self._join([head, *map(self.pieces.__getitem__, rest)])

    def encode(self, text: str | None):
        """The value of a whole text; null counts as empty."""
        if not text:
            return self._join([])
        if self._cut is None or not any(s in text for s in self._special):
            return self._plain(text)
        return self._join([self._special[p] if p in self._special else self._plain(p) for p in self._cut.split(text)])
