"""Splitting text into the pieces that byte-level BPE merges within."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

#: The published split pattern of the 50k byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The same three classes within U+0000..U+024F, where `re` needs no property tables.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"


@cache
def splitter() -> Callable[[str], list[str]]:
    """text -> pieces. Latin text goes through `re`, everything else through `regex`."""
    import regex

    latin = re.compile("[\0-ɏ]*").fullmatch
    quick = re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
        f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    ).findall
    full = regex.compile(PATTERN).findall
    return lambda text: quick(text) if latin(text) else full(text)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    rest = (b for b in range(256) if b not in printable)
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class Remembered(dict):
    """key -> `compute(key)`, filled on demand, in two generations of `limit` keys.

    A full generation becomes the old one; keys met again move to the new one, so that frequent
    keys stay and memory is bounded.
    """

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        return self.keep(key, value)

    def keep(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceCache(Remembered):
    """piece -> encoded bytes. Long pieces are not kept."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = 200_000, longest: int = 48):
        super().__init__(encode, limit)
        self.longest = longest

    def __missing__(self, piece: str) -> bytes:
        value = self.old.get(piece)
        if value is None:
            value = self.compute(piece)
            if len(piece) > self.longest:
                return value
        return self.keep(piece, value)
