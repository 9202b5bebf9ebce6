"""HTML as a stream of tags with exact spans, and texts rewritten by spans.

The tokenizer goes through a page once.  Comments, declarations and what is inside
script, style, textarea and title hold no tags; a `>` within quotes ends none.  A rewrite
is a list of (begin, end, new) over the characters of the page: what no edit touches
stays as it was, byte for byte.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd

from vellum.functions.kernels import lazy_udf, vectorised

MARK = re.compile(r"""<!--|<[!?]|<(?P<close>/?)(?P<name>[A-Za-z][\w:-]*)(?P<own>(?:[^>"']|"[^"]*"|'[^']*')*)>""")
ATTRIBUTE = re.compile(r"""(?P<name>[^\s=/"'>]+)(?:\s*=\s*(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>[^\s"'>]+)))?""")
#: Elements whose content is text only (fixed values).
RAW = frozenset(("script", "style", "textarea", "title"))


@dataclass(frozen=True)
class Attribute:
    value: str  #: as written, entities included
    begin: int  #: span of the value
    end: int
    quote: str


@dataclass(frozen=True)
class Tag:
    name: str
    close: bool
    begin: int
    end: int
    own: str  #: what is between the name and the end
    at: int  #: where own begins

    @property
    def attributes(self) -> dict[str, Attribute]:
        """By name in lower case; of attributes that repeat the first counts."""
        out: dict[str, Attribute] = {}
        for m in ATTRIBUTE.finditer(self.own):
            kind = next((k for k in ("double", "single", "bare") if m[k] is not None), None)
            span = m.span(kind) if kind else (m.end(), m.end())
            out.setdefault(m["name"].lower(), Attribute(m[kind] if kind else "", self.at + span[0], self.at + span[1], {"double": '"', "single": "'"}.get(kind, "")))
        return out

    def get(self, name: str, default: str = "") -> str:
        """An attribute's value with its entities decoded."""
        own = self.attributes.get(name)
        return default if own is None else html.unescape(own.value)

    def has_class(self, name: str) -> bool:
        return name in self.get("class").split()


def tags(page: str) -> Iterator[Tag]:
    """The tags of a page in order."""
    at = 0
    while m := MARK.search(page, at):
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
        elif m["name"] is None:
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
        else:
            tag = Tag(m["name"].lower(), bool(m["close"]), m.start(), m.end(), m["own"], m.start("own"))
            yield tag
            if tag.name in RAW and not tag.close and not tag.own.endswith("/"):
                end = re.compile(rf"</{tag.name}\b", re.I).search(page, at)
                at = end.start() if end else len(page)


@dataclass(frozen=True)
class Element:
    tag: Tag
    end: int  #: behind the closing tag; of one that is never closed, behind its own
    inner: tuple[int, int]
    closed: bool


def elements(page: str, names: Iterable[str] | None = None, ignore: Callable[[Tag], bool] | None = None) -> list[Element]:
    """The elements of these names in the order they open; a closing tag closes the nearest open one of its name."""
    wanted = None if names is None else frozenset(names)
    out: list[Element] = []
    open_: dict[str, list[int]] = {}
    for t in tags(page):
        if wanted is not None and t.name not in wanted:
            continue
        if not t.close:
            if not t.own.endswith("/"):
                open_.setdefault(t.name, []).append(len(out))
            out.append(Element(t, t.end, (t.end, t.end), False))
        elif open_.get(t.name):
            i = open_[t.name].pop()
            out[i] = Element(out[i].tag, t.end, (out[i].tag.end, t.begin), True)
    return out


def spliced(page: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """The page with spans replaced; an edit within another one's span goes with it."""
    out, at = [], 0
    for begin, end, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if begin < at:
            continue
        out += (page[at:begin], new)
        at = end
    return "".join((*out, page[at:]))


# ---------------------------------------------------------------- references


def references(page: str, names: tuple[str, ...] = ("href", "src")) -> list[dict]:
    """The attributes of a page that name another file, with the spans of their values."""
    return [{"tag": t.name, "attr": n, "ref": html.unescape(a.value).strip(), "begin": a.begin, "end": a.end, "tag_begin": t.begin, "tag_end": t.end, "alt": t.get("alt"), "quote": a.quote} for t in tags(page) if not t.close for n, a in t.attributes.items() if n in names]


REFERENCE = "struct<tag:string,attr:string,ref:string,begin:int,end:int,tag_begin:int,tag_end:int,alt:string,quote:string>"
references_udf = vectorised(references, f"array<{REFERENCE}>")


def _spliced_all(pages: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else p if e is None or not len(e) else spliced(p, [(x["begin"], x["end"], x["new"]) for x in e]) for p, e in zip(pages, edits, strict=True)], dtype=object)


#: (page, array of struct(begin, end, new)) to the rewritten page.
spliced_udf = lazy_udf(_spliced_all, "string")


# ---------------------------------------------------------------- transforms for print


@dataclass(frozen=True)
class PrintTexts:
    """Wordings and fixed values of pages that are printed."""

    interactive: str = '<div class="pdf-note"><strong>Interactive part.</strong> It works in a browser only; open the page online.</div>'
    on_platform: str = '<div class="pdf-note"><strong>Part of the platform.</strong> Open the page there to see it.</div>'
    video: str = "Video"
    embedded: str = "Embedded page"
    no_image: str = "Image missing"
    no_alt: str = "image missing"
    #: Addresses of the platform's own parts, hosts of videos, a player's own title, and a script that only starts an engine (fixed values).
    platform_prefix: str = "/d2l/"
    video_hosts: tuple[str, ...] = ("youtube", "vimeo", "panopto")
    player_title: str = "youtube video player"
    engine_only: str = r"^\s*initChecklistSync\s*\([^)]*\)\s*;?\s*$"


TEXTS = PrintTexts()
EMBED = re.compile(r"youtube(?:-nocookie)?\.com/embed/([A-Za-z0-9_-]+)")


def without_scripts(page: str, texts: PrintTexts = TEXTS) -> dict:
    """Scripts out; one that shows something of its own leaves a note.  One that is never closed stays."""
    edits, notes = [], 0
    for e in elements(page, ("script",)):
        if e.closed:
            body = page[slice(*e.inner)]
            silent = e.tag.get("src") or not body.strip() or re.match(texts.engine_only, body)
            notes += not silent
            edits.append((e.tag.begin, e.end, "" if silent else texts.interactive))
    return {"html": spliced(page, edits), "notes": notes}


def frames_to_links(page: str, texts: PrintTexts = TEXTS) -> str:
    """Frames become links to what they show; an embedded video to where it is watched, a part of the platform to a note."""
    edits = []
    for e in elements(page, ("iframe",)):
        src, title = e.tag.attributes.get("src"), e.tag.get("title").strip()
        src = "" if src is None else src.value
        if src.startswith(texts.platform_prefix):
            edits.append((e.tag.begin, e.end, texts.on_platform))
            continue
        watched = EMBED.search(src)
        link = html.escape(f"https://www.youtube.com/watch?v={watched[1]}" if watched else html.unescape(src))
        label = texts.video if any(h in src for h in texts.video_hosts) else texts.embedded
        named = f" {html.escape(title)}" if title and title.lower() != texts.player_title else ""
        edits.append((e.tag.begin, e.end, f'<div class="pdf-note"><strong>{label}.</strong>{named}<br><a href="{link}">{link}</a></div>'))
    return spliced(page, edits)


def printable(page: str, downloads: str = "download-container") -> dict:
    """What of a sheet goes on paper: the body without scripts, without its first heading and the paragraph right behind it, without downloads; links unwrapped.

    error tells a page without body or without heading.
    """
    found = elements(page, ("body", "script", "h1", "p", "div", "a"))
    body = next((e for e in found if e.tag.name == "body" and e.closed), None)
    if body is None:
        return {"html": None, "error": "no body"}
    begin, end = body.inner
    found = [e for e in found if begin <= e.tag.begin and e.end <= end]
    head = next((e for e in found if e.tag.name == "h1" and e.closed), None)
    if head is None:
        return {"html": None, "error": "no h1"}
    intro = next((e for e in found if e.tag.name == "p" and e.closed and e.tag.begin >= head.end and not page[head.end : e.tag.begin].strip()), None)
    blank = re.compile(r"\s*").match(page, head.end).end()
    edits = [(head.tag.begin, intro.end if intro else min(blank, end), "")]
    for e in found:
        if e.tag.name == "script" and e.closed or e.tag.name == "div" and e.closed and e.tag.has_class(downloads):
            edits.append((e.tag.begin, e.end, ""))
        elif e.tag.name == "a" and e.closed:
            edits += [(e.tag.begin, e.tag.end, ""), (e.inner[1], e.end, "")]
    return {"html": spliced(page[:end], edits)[begin:], "error": None}


without_scripts_udf = vectorised(lambda p: without_scripts(p), "struct<html:string,notes:int>")
frames_to_links_udf = vectorised(lambda p: frames_to_links(p), "string")
printable_udf = vectorised(lambda p: printable(p), "struct<html:string,error:string>")
