"""JavaScript object literals and the manifest written in one."""

from __future__ import annotations

import json
import re

from vellum.functions.kernels import vectorised

TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`)|(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_$][\w$]*)|(?P<sign>[{}\[\]:,;])""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _text(raw: str) -> str:
    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else ESCAPES.get(m[2], m[2]), raw[1:-1], flags=re.S)


def parse_literal(text: str, start: int = 0):
    """The object or array literal that begins at start: single quotes, bare keys, comments and trailing commas allowed."""
    tokens: list[tuple[str, str]] = []
    at, depth = start, 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
            depth += (m[0] in "{[") - (m[0] in "}]") if m.lastgroup == "sign" else 0
            if not depth:
                break
    k = 0

    def take() -> tuple[str, str]:
        nonlocal k
        if k >= len(tokens):
            raise ValueError("the literal does not end")
        k += 1
        return tokens[k - 1]

    def value():
        nonlocal k
        kind, raw = take()
        if kind == "str":
            return _text(raw)
        if kind == "num":
            return float(raw) if set(".eE") & set(raw) else int(raw)
        if kind == "word":
            return {"true": True, "false": False, "null": None, "undefined": None}[raw]
        if raw == "[":
            out: list = []
            while tokens[k : k + 1] != [("sign", "]")]:
                out.append(value())
                if tokens[k : k + 1] == [("sign", ",")]:
                    k += 1
            k += 1
            return out
        if raw == "{":
            found: dict = {}
            while tokens[k : k + 1] != [("sign", "}")]:
                kind, key = take()
                if take()[1] != ":":
                    raise ValueError("a colon is missing")
                found[_text(key) if kind == "str" else key] = value()
                if tokens[k : k + 1] == [("sign", ",")]:
                    k += 1
            k += 1
            return found
        raise ValueError(f"unexpected {raw!r}")

    return value()


def literal_json(text: str) -> str | None:
    """JSON of the first literal that is assigned in a script; null without one or if it is broken."""
    m = re.search(r"=\s*(?=[{\[])", text)
    try:
        return json.dumps(parse_literal(text, m.end()), ensure_ascii=False) if m else None
    except (ValueError, KeyError):
        return None


literal_json_udf = vectorised(literal_json, "string")


def manifest_modules(text: str) -> list[dict]:
    """[{module, n_categories, topics: [{id, name, href}]}] of a manifest of modules with categories of topics."""
    m = re.search(r"=\s*(?=\{)", text)
    try:
        doc = parse_literal(text, m.end()) if m else {}
    except (ValueError, KeyError):
        return []
    out = []
    for name, body in doc.items():
        groups = [g for g in (body.get("categories") or body.get("items") or []) if isinstance(g, dict)] if isinstance(body, dict) else []
        with_topics = [g for g in groups if isinstance(g.get("topics"), list)]
        topics = [t for g in with_topics for t in g["topics"] if isinstance(t, dict)]
        out.append({"module": name, "n_categories": sum(1 for g in with_topics if isinstance(g.get("name"), str)), "topics": topics})
    return out
