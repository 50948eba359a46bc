"""Cuts texts into the pieces of the public tokenizers' pattern, a whole text at a time.

The pattern is public_tokenizers.PATTERN:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import functools
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import regex

_LETTER, _NUMBER, _SPACE = 1, 2, 3
_CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.zeros(0x110000, np.uint8)
    for value, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            classes[np.frombuffer(run[0].encode("utf-32-le"), np.uint32)] = value
    return classes


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return _classes() == _LETTER


@functools.cache
def _latin_pattern() -> re.Pattern:
    """The pattern for texts of Latin-1 characters, as explicit sets for the faster standard library."""
    sets = {k: re.escape("".join(chr(i) for i in np.flatnonzero(_classes()[:256] == k))) for k in (_LETTER, _NUMBER, _SPACE)}
    word, number, space = sets.values()
    # The first three begin with different characters, so the commonest comes first.
    return re.compile(
        f" ?[{word}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{word}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def cut(text: str) -> list[str]:
    """The matches of the pattern in a text, in order; together they are the text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _cut_any(text)
    return _latin_pattern().findall(text)


def _cut_any(text: str) -> list[str]:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    starts = np.empty(len(points), bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    # The last of several white spaces before something else stands alone, or, if a blank, with what follows.
    space = kind == _SPACE
    last = np.zeros(len(points), bool)
    np.logical_and(space[:-1], ~space[1:], out=last[:-1])
    starts |= last
    starts[1:] &= ~(last & (points == 32))[:-1]
    if "'" in text:
        for m in _CONTRACTION.finditer(text):
            if starts[m.start()]:
                starts[m.start() + 1 : m.end()] = False
                if m.end() < len(starts):
                    starts[m.end()] = True
    at = np.flatnonzero(starts).tolist()
    at.append(len(text))
    return [text[a:b] for a, b in zip(at, at[1:])]


def packed(ids: list[int], narrow: bool = False) -> bytes:
    """ids as little-endian unsigned integers of 32 bits (narrow: 16)."""
    out = array("H" if narrow else "I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Memo(dict):
    """A memo of at most twice `size` entries of short keys: when full, only what is asked for again is kept."""

    #: Keys of more characters are computed anew each time, so that the memo's bytes are bounded too.
    LONGEST = 64

    def __init__(self, compute: Callable, size: int):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.compute(key)
        if key in self.old:
            found = self.old.pop(key)
        else:
            found = self.compute(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class TextEncoder:
    """text -> ids as little-endian unsigned integers, by an encoder of single pieces whose results are memoised.

    Workers outlive their tasks, so the memo (about 100 MB at most) stays with them.
    """

    def __init__(self, encode_piece: Callable[[str], bytes], memo_size: int = 250_000):
        self.pieces = Memo(encode_piece, memo_size)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, cut(text)))
