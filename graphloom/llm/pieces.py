"""Cutting texts where byte-level BPE with the 50k vocabulary's pattern always cuts.

The pattern's tokens hold a space at their start only, except runs of white space; such a run gives its
last space to the word behind it. So there is always a cut before a space that is followed by something
other than white space, and the tokens of a text are those of its pieces, one after the other.

Scripts that write no spaces give long pieces. Nothing but runs of white space looks at what follows, so there is
also a cut between any two tokens of the pattern, where letters, digits and other characters change. A run
of letters alone has no safe cut inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import regex

#: Fixed value: the public pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TOKEN = regex.compile(PATTERN)
#: Pieces of more characters are cut between the pattern's tokens, and never remembered whole.
LONG = 48
#: Bytes of pieces, with what is kept about each, that a worker remembers at most.
KNOWN_BYTES = 48 << 20
#: What an entry of a dictionary takes beside its text.
ENTRY_BYTES = 160

#: Fixed value: Unicode's White_Space code points, in a regular expression's class.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_RUN = re.compile(f" (?=[{WHITE}]|$)")
_CUT = re.compile(f" (?=[^{WHITE}])")


def split_words(text: str) -> list[str]:
    """Pieces without the space they begin with: the first begins the text, each other one follows a
    space. ``" ".join(pieces)`` is the text."""
    if _RUN.search(text):
        return _CUT.split(text)
    return text.split(" ")


def tokens_of(piece: str) -> list[str]:
    """The pattern's tokens of a piece."""
    return _TOKEN.findall(piece)


def known_bytes(pieces: Iterable[str]) -> int:
    """About what it takes to remember these pieces."""
    return sum(ENTRY_BYTES + 4 * len(p) for p in pieces)


def special_splitter(specials: list[str]) -> re.Pattern | None:
    """A pattern that splits texts at special strings and keeps these (longest first)."""
    if not specials:
        return None
    return re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")
