"""Markup that nests: lists as a tree, and blocks left out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

ATTRIBUTE = re.compile(r'([\w-]+)\s*=\s*"([^"]*)"')


@dataclass
class Element:
    name: str
    tag: str  #: the opening tag
    begin: int  #: where its body begins
    end: int | None = None  #: where its body ends; None if it is never closed
    children: list[Element] = field(default_factory=list)

    @property
    def attributes(self) -> dict[str, str]:
        return dict(ATTRIBUTE.findall(self.tag))

    def has_class(self, name: str) -> bool:
        return name in self.attributes.get("class", "").split()


def list_tree(fragment: str) -> list[Element]:
    """The outermost list elements; a closing tag closes the nearest open element of its name and all within."""
    roots: list[Element] = []
    path: list[Element] = []
    for m in re.finditer(r"<(/?)(ul|ol|li)\b[^>]*>", fragment):
        if not m[1]:
            new = Element(m[2], m[0], m.end())
            (path[-1].children if path else roots).append(new)
            path.append(new)
        elif any(e.name == m[2] for e in path):
            while path:
                last = path.pop()
                if last.name == m[2]:
                    last.end = m.start()
                    break
    return roots


def walk(elements: list[Element]) -> Iterator[Element]:
    """All elements in the order they open."""
    for e in elements:
        yield e
        yield from walk(e.children)


def outer_lists(elements: list[Element]) -> Iterator[Element]:
    """Lists that are in no other list; an item outside any list is looked into."""
    for e in elements:
        if e.name == "li":
            yield from outer_lists(e.children)
        else:
            yield e


def items(of: Element, fragment: str) -> list[tuple[str, str]]:
    """(opening tag, body) of a list's own closed items."""
    return [(e.tag, fragment[e.begin : e.end]) for e in of.children if e.name == "li" and e.end is not None]


def list_items(fragment: str, tag: str) -> list[tuple[str, str]]:
    """(opening tag, body) of the items of the first list of this tag, wherever it is."""
    first = next((e for e in walk(list_tree(fragment)) if e.name == tag), None)
    return items(first, fragment) if first else []


def question_lists(fragment: str, mark: str = "vragen") -> list[dict]:
    """The outermost numbered lists of the question class.

    A list begins at its start attribute, or goes on from the list before it; both are
    given (begin, expected), and whether the attribute is there.
    """
    out: list[dict] = []
    for e in outer_lists(list_tree(fragment)):
        if e.name == "ol" and e.has_class(mark):
            expected = out[-1]["begin"] + len(out[-1]["items"]) if out else 1
            own = e.attributes.get("start", "")
            declared = own.isascii() and own.isdigit()
            out.append({"list_no": len(out) + 1, "begin": int(own) if declared else expected, "declared": declared, "expected": expected, "items": [{"tag": t, "body": b} for t, b in items(e, fragment)]})
    return out


def blanks_without_class(fragment: str, mark: str = "vragen", blank: str = "invulruimte") -> bool:
    """Whether a numbered list without the question class has an item with a blank to fill in."""
    plain = (e for e in walk(list_tree(fragment)) if e.name == "ol" and not e.has_class(mark))
    return any(blank in body for e in plain for _, body in items(e, fragment))


PART = re.compile(r"<(?P<close>/?)div\b(?P<own>[^>]*)>", re.I)


def drop_blocks(text: str, mark: str = "solution-container", heading: str | None = "Oplossing", reach: int = 200) -> str:
    """Without the div blocks of a class, each with a heading of this text that stands right before it.

    The heading must lie within `reach` characters before the block; other headings stay.
    A block that is never closed ends with the last div tag after it.
    """
    title = re.compile(rf"<(h[1-6])\b[^>]*>\s*{re.escape(heading or '')}\s*</\1>\s*$", re.I) if heading else None
    kept, copied, depth = "", 0, 0
    for m in PART.finditer(text):
        if depth:
            depth += -1 if m["close"] else 1
            copied = m.end()
        elif not m["close"] and re.search(rf'class="[^"]*\b{re.escape(mark)}\b', m["own"], re.I):
            kept += text[copied : m.start()]
            found = title.search(kept, max(0, len(kept) - reach)) if title else None
            kept = kept[: found.start()] if found else kept
            copied, depth = m.end(), 1
    return kept + text[copied:]
