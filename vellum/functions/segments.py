"""Inline markup as text segments with their styles, by a pushdown automaton over the tag stream."""

from __future__ import annotations

import html
import re

from vellum.functions.kernels import vectorised
from vellum.functions.tokens import tags

#: Elements that style their text, and the style's name; elements whose text is not read (fixed values).
STYLES = {"code": "code", "kbd": "kbd", "strong": "vet", "b": "vet", "em": "cursief", "i": "cursief"}
UNREAD = frozenset(("script", "style", "head", "template"))


def segments(fragment: str) -> list[dict]:
    """(text, styles) in order; white space is folded across tags, so that one blank stays between two words, none at the ends.

    Styles are those of the open elements, each once, in order of the alphabet.  A closing
    tag closes the nearest open element of its name and what is open within it.
    """
    raw: list[tuple[str, tuple[str, ...]]] = []
    open_: list[str] = []
    at = 0

    def text(to: int) -> None:
        if to > at and not UNREAD & set(open_):
            styles = tuple(sorted({STYLES[n] for n in open_ if n in STYLES}))
            raw.extend((html.unescape(part), styles) for part in re.split(r"(?s)<!--.*?(?:-->|\Z)|<[!?][^>]*>", fragment[at:to]))

    for t in tags(fragment):
        text(t.begin)
        at = t.end
        if not t.close:
            if (t.name in STYLES or t.name in UNREAD) and not t.own.endswith("/"):
                open_.append(t.name)
        elif t.name in open_:
            del open_[len(open_) - 1 - open_[::-1].index(t.name) :]
    text(len(fragment))

    out: list[list] = []
    for plain, styles in raw:
        folded = re.sub(r"\s+", " ", plain)
        if not out or out[-1][0].endswith(" "):
            folded = folded.removeprefix(" ")
        if folded:
            out.append([folded, styles])
    while out and not (last := out[-1][0].rstrip(" ")):
        out.pop()
    if out:
        out[-1][0] = last
    return [{"text": x, "styles": list(s)} for x, s in out]


segments_udf = vectorised(segments, "array<struct<text:string,styles:array<string>>>")
