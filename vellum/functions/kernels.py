"""Kernels that built-in expressions cannot express: depth counters, Unicode folding, backtracking grammars.

Each is a plain function on one value; `vectorised` wraps it as an Arrow-batched
pandas UDF.  Everything else lives in functions.text.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.lexer import shared_brace, spaced, squeezed, tidy, tight_operators, without_generics  # noqa: F401
from vellum.functions.markup import blanks_without_class, drop_blocks, list_items, question_lists


def lazy_udf(fn: Callable, kind: str | T.DataType) -> Callable[..., Column]:
    """A pandas UDF that is made when it is used, so that importing needs no session."""
    return lambda *cols: F.pandas_udf(fn, kind)(*cols)


def vectorised(fn: Callable, kind: str) -> Callable[..., Column]:
    """A pandas UDF of a one-value function; null in, null out."""

    is_struct = kind.startswith("struct<")

    def run(s: pd.Series):
        got = [None if x is None or (isinstance(x, float) and x != x) else fn(x) for x in s]
        return pd.DataFrame([g or {} for g in got]) if is_struct else pd.Series(got, dtype=object)

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame if is_struct else pd.Series}
    return lazy_udf(run, kind)


ITEM = "struct<tag:string,body:string>"
QUESTION_LISTS = f"array<struct<list_no:int,begin:int,declared:boolean,expected:int,items:array<{ITEM}>>>"
question_lists_udf = vectorised(question_lists, QUESTION_LISTS)
choices_udf = vectorised(lambda body: [{"tag": t, "body": b} for t, b in list_items(body, "ul")], f"array<{ITEM}>")


def objectives(fragment: str, heading: str = "doelstellingen") -> list[dict]:
    """Items of the first ordered list between this heading and the next h2."""
    found = re.search(rf'<h2\b[^>]*\bid="{heading}"[^>]*>', fragment)
    if not found:
        return []
    section = re.split(r"<h2\b", fragment[found.end() :], maxsplit=1)[0]
    return [{"tag": t, "body": b} for t, b in list_items(section, "ol")]


objectives_udf = vectorised(objectives, f"array<{ITEM}>")


blanks_udf = vectorised(blanks_without_class, "boolean")


def unclosed_comments(text: str) -> list[int]:
    """Lines of the comment openings that the next opening, or the end, comes before their close."""
    out = []
    for m in re.finditer("<!--", text):
        close, again = text.find("-->", m.end()), text.find("<!--", m.end())
        if close < 0 or -1 < again < close:
            out.append(text.count("\n", 0, m.start()) + 1)
    return out


unclosed_udf = vectorised(unclosed_comments, "array<int>")
unescape_udf = vectorised(html.unescape, "string")


def ascii_slug(text: str, fallback: str = "item") -> str:
    """Compatibility forms decomposed, what is not ASCII dropped, then a slug."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]+", "-", plain.lower()).strip("-") or fallback


ascii_slug_udf = vectorised(ascii_slug, "string")


def without_accents(text: str) -> str:
    """Base letters of accented ones; other letters stay."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def pascal(text: str, short: dict[str, str] | None = None) -> str:
    """Words joined, each with a capital; known words are first replaced by their short form."""
    words = re.findall(r"[A-Za-z0-9]+", without_accents(text))
    return "".join(short.get(w.lower(), w[:1].upper() + w[1:]) if short else w[:1].upper() + w[1:] for w in words)


without_accents_udf = vectorised(without_accents, "string")
pascal_udf = vectorised(pascal, "string")


def well_formed(xml: str) -> str:
    """'' if the text is well-formed XML, else what is wrong with it."""
    try:
        ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        return str(e)
    return ""


well_formed_udf = vectorised(well_formed, "string")


# ---------------------------------------------------------------- code lines

tight_udf = vectorised(tight_operators, "array<string>")
squeezed_udf = vectorised(squeezed, "boolean")
shared_brace_udf = vectorised(shared_brace, "boolean")
spaced_udf = vectorised(spaced, "string")
tidy_udf = vectorised(tidy, "array<string>")


# ---------------------------------------------------------------- names


SCORE = " (!)"


def name_series(rest: str, names: list[str], glue: str = " en ") -> list[str] | None:
    """Names, each at most once and in the given order, that joined by the glue make up rest.

    All readings are followed name by name; of several, the one with the earliest names counts.
    """
    readings, whole = [(0, ())], []  # how much is read, and the numbers of the names read
    for i, name in enumerate(names):
        longer = []
        for at, read in readings:
            if rest.startswith(name, at):
                end = at + len(name)
                if end == len(rest):
                    whole.append((*read, i))
                elif rest.startswith(glue, end):
                    longer.append((end + len(glue), (*read, i)))
        readings += longer
    return [names[i] for i in min(whole)] if whole else None


def part_problem(part: str) -> str | None:
    """What is wrong with the part after the colon, None if nothing is."""
    if part != part.strip() or not part:
        return "the part is empty or padded"
    if "(" in part or ")" in part:
        return "the part has brackets"
    return None if part[0].isupper() or part[0].isdigit() else "the part begins with a small letter"


def parse_name(text: str, own: str | None, names: list[str], ungraded: str = "Verslag", test: str = "Test labo", graded: str = "Opdracht") -> tuple[str | None, str | None]:
    """(kind, part) of a well-formed name; (None, what is wrong) of another.

    A name is its kind, what it is about, and a score mark exactly if it counts.  A test
    is about modules of the menu, in its order, its own among them; the others are about
    their own module, perhaps with a part after a colon.
    """
    if own is None:
        return None, "no module above has a name"
    kind = max((k for k in (graded, ungraded, test) if text.startswith(k + " ")), key=len, default=None)
    about = text[len(kind) + 1 :] if kind else ""
    scored = about.endswith(SCORE) and about != SCORE
    about = about.removesuffix(SCORE) if scored else about
    if not about:
        return None, "does not begin with a known kind"
    if kind == test:
        if own not in (name_series(about, names) or ()):
            return None, "does not list the names of the tested modules in order"
        return ("test", None) if scored else (None, "a test needs its score mark")
    part = None
    if about != own:
        if not about.startswith(own + ": "):
            return None, "does not name the module above"
        part = about.removeprefix(own + ": ")
        if wrong := part_problem(part):
            return None, wrong
    if scored != (kind == graded):
        return None, "the score mark does not fit the kind"
    return ("assignment" if kind == graded else "report"), part


PARSED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("part", T.StringType())])


def name_parser(names: list[str], **words: str):
    """pandas UDF (text, own name) to struct(kind, part); the list of names is bounded by the menu."""

    def run(text: pd.Series, own: pd.Series) -> pd.DataFrame:
        got = [(None, None) if t is None else parse_name(t, None if not isinstance(o, str) else o, names, **words) for t, o in zip(text, own, strict=True)]
        return pd.DataFrame(got, columns=["kind", "part"])

    run.__annotations__ = {"text": pd.Series, "own": pd.Series, "return": pd.DataFrame}
    return lazy_udf(run, PARSED)


def names_parser(**words: str):
    """pandas UDF (text, own name, names of the menu's modules) to struct(kind, part); no list leaves its menu."""

    def run(text: pd.Series, own: pd.Series, names: pd.Series) -> pd.DataFrame:
        got = [(None, None) if t is None else parse_name(t, None if not isinstance(o, str) else o, [] if n is None else list(n), **words) for t, o, n in zip(text, own, names, strict=True)]
        return pd.DataFrame(got, columns=["kind", "part"])

    run.__annotations__ = {"text": pd.Series, "own": pd.Series, "names": pd.Series, "return": pd.DataFrame}
    return lazy_udf(run, PARSED)


# ---------------------------------------------------------------- runs of words


def longest_run(a: list[str], b: list[str]) -> tuple[int, int]:
    """(start in a, length) of the longest common run of words, the first of equals.

    Only places of equal words are looked at, each extended from the one before it.
    """
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    best, before = (0, 0), {}
    for i, x in enumerate(a):
        now = {}
        for j in places.get(x, ()):
            n = now[j] = before.get(j - 1, 0) + 1
            if n > best[1]:
                best = (i - n + 1, n)
        before = now
    return best


def _longest_runs(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([longest_run(list(x), list(y)) for x, y in zip(a, b, strict=True)], columns=["start", "length"])


longest_run_udf = lazy_udf(_longest_runs, "struct<start:int,length:int>")


# ---------------------------------------------------------------- markup that nests


drop_solutions_udf = vectorised(drop_blocks, "string")


def collision_names(wanted: list[str], taken: list[str] = ()) -> list[str]:
    """File names in order, each taken one (in any case) with a growing suffix: x, x-2, x-2-3."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if stem else (name, "")
        suffix = itertools.count(2)
        while (stem + ext).lower() in used:
            stem += f"-{next(suffix)}"
        used.add((stem + ext).lower())
        out.append(stem + ext)
    return out


def chain(stem: str) -> tuple[str, int]:
    """What a stem is the n-th name of: x-2-3 is the third of x; a stem without such an end is the first of its own."""
    number = stem.rpartition("-")[2]
    if number.isascii() and number.isdigit() and 2 <= int(number[:9]) <= len(stem) // 2 + 1:
        end = "".join(f"-{i}" for i in range(2, int(number[:9]) + 1))
        if stem.endswith(end):
            return stem[: len(stem) - len(end)], int(number)
    return stem, 1


def chain_root(stem: str) -> str:
    """The stem without any ends of chains: names of different roots never collide."""
    root, n = chain(stem)
    while n > 1:
        stem = root
        root, n = chain(stem)
    return stem


class Numbers:
    """collision_names for stems of one root and extension, in numbers: each name is (stem, n) by `chain`, and takes no longer the later it comes."""

    def __init__(self):
        self.next: dict[str, int] = {}  # by stem: all names before this one are taken
        self.ahead: dict[str, set[int]] = {}  # further ones, taken by those who wished just them

    def name(self, stem: str) -> tuple[str, int]:
        key = stem.lower()
        (root, n), (own, _) = chain(key), chain(stem)
        if n > 1:
            ahead = self.ahead.setdefault(root, set())
            if n >= self.next.get(root, 0) and n not in ahead:
                ahead.add(n)
                return own, n
        at, ahead = self.next.get(key, 1 if n == 1 else 2), self.ahead.get(key, ())
        while at in ahead:
            ahead.remove(at)
            at += 1
        self.next[key] = at + 1
        return stem, at


#: Elements kept when markup is carried over to XHTML (fixed values).
XHTML_KEEP = frozenset("p ul ol li pre code em strong b i u sub sup br img table thead tbody tr td th blockquote span div a".split())


def to_xhtml(fragment: str) -> dict:
    """Well-formed XHTML of a fragment; unknown elements are unwrapped and reported."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.open, self.unwrapped = [], [], []

        def handle_starttag(self, tag, attrs):
            if tag not in XHTML_KEEP:
                self.unwrapped.append(tag)
                return
            own = "".join(f' {k}="{html.escape(v or "")}"' for k, v in attrs)
            if tag in ("br", "img"):
                self.out.append(f"<{tag}{own}/>")
            else:
                self.out.append(f"<{tag}{own}>")
                self.open.append(tag)

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag in self.open[-1:]:
                self.handle_endtag(tag)

        def handle_endtag(self, tag):
            if tag in self.open:
                while self.open:
                    top = self.open.pop()
                    self.out.append(f"</{top}>")
                    if top == tag:
                        break

        def handle_data(self, data):
            self.out.append(html.escape(data, quote=False))

    r = Reader()
    r.feed(fragment)
    r.close()
    while r.open:
        r.out.append(f"</{r.open.pop()}>")
    return {"xhtml": "".join(r.out), "unwrapped": sorted(set(r.unwrapped))}


xhtml_udf = vectorised(to_xhtml, "struct<xhtml:string,unwrapped:array<string>>")
