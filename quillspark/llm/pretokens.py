"""Splitting texts into the pre-tokens of a byte-level BPE."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

#: Below this code point the character classes are built by rule from the categories, which all libraries share.
PLAIN_END = 0x250
_ODD = re.compile(f"[^\x00-{chr(PLAIN_END - 1)}]")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == kind)


@lru_cache
def plain_pattern() -> re.Pattern:
    """The pre-token pattern for texts of characters below PLAIN_END, for the faster `re`; letters are tried first, which changes no match."""
    letters, numbers = _class("L"), _class("N")
    white = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(
        f" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+|[{white}]+(?![^{white}])|[{white}]+"
    )


def is_plain(text: str) -> bool:
    return text.isascii() or _ODD.search(text) is None


@lru_cache
def full_pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)
