"""Splitting a text at places where byte-level BPE never merges, and encoding the parts with a word cache.

The pattern of the vocabularies attaches a space to the run of letters, digits or other marks behind it. So a token
always begins at a space that is followed by something else than white space, and a line feed between two characters
that aren't white space is a token of its own. Such places are *safe boundaries*, and the parts between them can be
encoded apart. Parts repeat, so a bounded cache holds their encodings.
"""

from __future__ import annotations

import re
from collections.abc import Callable

CACHE_PARTS = 300_000
CACHE_LENGTH = 48
_LOOSE = re.compile(r"[ \n](?:\s|\Z)|\A\n|[^\S \n]\n")


class PartCache:
    """Encodings of parts, computed for many missing parts at once.

    ``encode_many`` turns a list of strings into a list of values. A value stands for the ids of one part; the values
    of a text's parts in order stand for the text.
    """

    def __init__(self, encode_many: Callable[[list[str]], list], parts: int = CACHE_PARTS):
        self.encode_many, self.parts = encode_many, parts
        self.known: dict[str, object] = {}

    def encode(self, texts: list[str]) -> list[list]:
        """The values of each text's parts. An empty text has none."""
        split = [parts_of(t) for t in texts]
        known = self.known
        missing = list({p for parts in split for p in parts}.difference(known))
        known.update(zip(missing, self.encode_many(missing)))
        out = [[known[p] for p in parts] for parts in split]
        if len(known) > self.parts:
            known.clear()
        else:
            for p in missing:
                if len(p) > CACHE_LENGTH:
                    del known[p]
        return out


def parts_of(text: str) -> list[str]:
    """The text cut at every safe boundary (in loosely spaced texts, at those before a space)."""
    if not text:
        return []
    if _LOOSE.search(text):
        return _merged(text.split(" "))
    out: list[str] = []
    for line in text.split("\n"):
        first, *others = line.split(" ")
        if first:
            out.append(first)
        out += [" " + w for w in others]
        out.append("\n")
    out.pop()
    return out


def _merged(words: list[str]) -> list[str]:
    """White space before a boundary stays with the part before it."""
    out, part = [], [words[0]]
    for w in words[1:]:
        if w and not w[0].isspace():
            out.append(" ".join(part))
            part = ["", w]
        else:
            part.append(w)
    out.append(" ".join(part))
    return [p for p in out if p]
