"""Regex character classes made from Python's Unicode tables, so that JVM tables of another age don't matter."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

#: White space as Python's str.isspace has it.
SPACE = r"(?U)[\s\x1c-\x1f]"
SPACES = SPACE + "+"

# Code point ranges of Arabic letters, presentation forms and replacement glyphs.
ARABIC = ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF))
PRESENTATION = ((0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
CONTROLS = ((0x00, 0x08), (0x0E, 0x1B), (0x7F, 0x9F))
REPLACEMENT = ((0xFFFD, 0xFFFD), (0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD), (0x25A0, 0x25A1), (0x25CB, 0x25CF), (0x2588, 0x2588))


def _ranges(test: Callable[[str], bool], within: tuple[tuple[int, int], ...] = ((0, sys.maxunicode),)) -> str:
    out = []
    for lo, hi in sorted(within):
        begin = None
        for cp in range(lo, hi + 2):
            yes = cp <= hi and not 0xD800 <= cp <= 0xDFFF and test(chr(cp))
            if yes and begin is None:
                begin = cp
            elif not yes and begin is not None:
                out.append(rf"\x{{{begin:X}}}-\x{{{cp - 1:X}}}")
                begin = None
    return "[" + "".join(out) + "]"


def _letter(c: str) -> bool:
    return unicodedata.category(c)[0] == "L"


@cache
def letters() -> str:
    return _ranges(_letter)


@cache
def arabic_letters(base: bool = True, presentation: bool = True) -> str:
    return _ranges(_letter, ARABIC * base + PRESENTATION * presentation)


@cache
def bidi(kind: str) -> str:
    """Code points of strong direction: "R" (right to left, Arabic included) or "L"."""
    wanted = {"R": ("R", "AL"), "L": ("L",)}[kind]
    return _ranges(lambda c: unicodedata.bidirectional(c) in wanted)


@cache
def replacement() -> str:
    return "[" + r"\x00-\x08\x0E-\x1B\x7F-\x9F" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in REPLACEMENT) + "]"
