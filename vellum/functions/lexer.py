"""A small lexer for lines of brace-and-semicolon languages, and what is judged and repaired with it.

A line comes as it stands in a page, so a sign may be an entity.  A token keeps its raw
text and knows the plain sign it stands for; joining the raw texts gives the line back.
Type arguments are recognised by parsing and become part of the type's name, so what is
left of < and > compares or shifts.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

LT, GT, AND = "(?:<|&lt;)", "(?:>|&gt;)", "(?:&amp;|&(?!(?:lt|gt|amp|quot|#39);))"
LEXEMES = {
    "blank": r"\s+",
    "string": r"""\"(?:[^"\\]|\\.)*"|&quot;(?:(?!&quot;).)*&quot;""",
    "char": r"'[^']*'|&#39;(?:(?!&#39;).)*&#39;",
    "note": "//.*",
    "word": r"[A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)*",
    "number": r"\d[\w.]*",
    "arrow": f"-{GT}",
    "compare": f"[=!]==?|(?:{LT}|{GT})=",
    "logic": rf"{AND}{AND}|\|\|",
    "compound": rf"(?:[+\-*/%|^]|{AND})=",
    "sign": f"{LT}|{GT}|{AND}|.",
}
LEXEME = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in LEXEMES.items()), re.S)
TAG, INCLUDE = re.compile("<[a-zA-Z/!]"), re.compile(r"\s*#\s*include")
#: Words whose condition has a blank before its bracket (fixed values).
CONDITIONAL = frozenset(("if", "for", "while", "switch"))


@dataclass
class Token:
    kind: str
    raw: str
    plain: str

    def is_value_end(self) -> bool:
        return self.kind in ("word", "number") or self.plain in (")", "]")

    def is_operand(self, *signs: str) -> bool:
        return self.kind in ("word", "number") or self.plain in ("(", *signs)


def _type_arguments(tokens: list[Token], i: int) -> int | None:
    """Where the type arguments that open at token i end; None if this is no such list."""

    def at(k: int) -> str:
        return tokens[k].plain if k < len(tokens) else ""

    def skip(k: int) -> int:
        return k + (k < len(tokens) and tokens[k].kind == "blank")

    k = i
    while at(k) in ("<", ","):
        k = skip(k + 1)
        if k >= len(tokens) or tokens[k].kind != "word":
            return None
        k += 1
        if at(k) == "<":
            inner = _type_arguments(tokens, k)
            if inner is None:
                return None
            k = inner
        k += 2 * (at(k) == "[" and at(k + 1) == "]")
        k = skip(k + (at(k) == "?"))
    return k + 1 if at(k) == ">" else None


def lex(line: str) -> list[Token]:
    """Tokens of a line; a type with its arguments is one word, two angles side by side are one shift."""
    flat = [Token(m.lastgroup, m[0], html.unescape(m[0])) for m in LEXEME.finditer(line)]
    out: list[Token] = []
    k = 0
    while k < len(flat):
        t = flat[k]
        upto = _type_arguments(flat, k + 1) if t.kind == "word" and flat[k + 1 : k + 2] and flat[k + 1].plain == "<" else None
        if upto is None and t.plain in ("<", ">"):
            t.kind = "compare"
            if k + 1 < len(flat) and flat[k + 1].plain == t.plain:
                upto, t = k + 2, Token("shift", "", "")
        if upto is None:
            out.append(t)
            k += 1
        else:
            raw = "".join(x.raw for x in flat[k:upto])
            out.append(Token(t.kind, raw, html.unescape(raw)))
            k = upto
    for t in out:
        if t.plain == "=":
            t.kind = "assign"
    return out


def without_generics(code: str) -> str:
    """The code without the arguments of its types."""
    return "".join(re.split("<|&lt;", t.raw, maxsplit=1)[0] if t.kind == "word" else t.raw for t in lex(code))


def statement(line: str) -> list[Token] | None:
    """Tokens of a line that is code and not prose: without markup, ending in one of ;{}(), but for a comment."""
    if TAG.search(line) or INCLUDE.match(line):
        return None
    tokens = lex(line)
    solid = [t for t in tokens if t.kind not in ("blank", "note")]
    return tokens if solid and solid[-1].plain in tuple(";{}(),") else None


def _gaps(tokens: list[Token]):
    """(left, right, what wants a blank between them) of neighbours without one."""
    for left, right in zip(tokens, tokens[1:], strict=False):
        if "blank" in (left.kind, right.kind) or right.kind == "note":
            continue
        literal = right.kind in ("string", "char")
        # an operator after a value
        if right.kind in ("assign", "compare", "logic") and (left.is_value_end() or left.kind == "string"):
            yield left, right, right
        # an operand after an operator or a separator
        elif left.kind == "assign" and (literal or right.is_operand("!", "~", "+", "-")):
            yield left, right, left
        elif left.kind in ("compare", "logic") and (right.kind == "string" or right.is_operand("!", "~", "-")):
            yield left, right, left
        elif left.plain == ";" and (right.kind == "string" or right.is_operand()):
            yield left, right, left
        elif left.plain == "," and (literal or right.is_operand("{", "!", "~", "-")):
            yield left, right, left
        elif left.plain in CONDITIONAL and right.plain == "(":
            yield left, right, left


def _name_if_reported(left: Token, right: Token, cause: Token) -> str | None:
    """What a finding calls a missing blank; some gaps are repaired along the way but not reported."""
    if cause is right and left.kind == "string":
        return None
    if cause.kind == "assign":
        return "=" if cause is right or right.plain not in ("!", "~", "+") else None
    if cause.kind in ("compare", "logic"):
        also = ("!",) if cause.kind == "logic" else ()
        reported = cause is right or right.is_operand(*also)
        return ("comparison" if cause.kind == "compare" else "&&/||") if reported else None
    if cause.plain == ";":
        return ";" if right.kind in ("word", "number") else None
    if cause.plain == ",":
        return "," if right.plain not in ("!", "~") else None
    return "keyword("


#: The order in which findings name them.
NAMES = ("=", "comparison", "&&/||", ";", ",", "keyword(")


def tight_operators(line: str) -> list[str]:
    """Names of the operators without a space around them; of none if the line is no statement."""
    tokens = statement(re.sub(r"^\s*<code>", "", line))
    names = {_name_if_reported(*gap) for gap in _gaps(tokens or [])}
    return [n for n in NAMES if n in names]


def squeezed(bare: str) -> bool:
    """Whether a comparison, logical sign or assignment touches what stands on both its sides, in strings too."""
    for m in re.finditer(r"[=!<>]=|&&|\|\||=", bare):
        left, right = bare[: m.start()][-1:], bare[m.end() :][:1]
        if left.isascii() and right.isascii() and (left.isalnum() or left in tuple("_)]")) and (right.isalnum() or right in tuple("_(\"'")):
            return True
    return False


def shared_brace(bare: str) -> bool:
    """Whether an opening brace shares its line with what it belongs to.

    The brace of an object initialiser (= new T() { ... }) belongs to its line, as does
    one at the end of a line with an assignment.
    """
    solid = [t for t in lex(bare) if t.kind != "note"]
    while solid and solid[-1].kind == "blank":
        solid.pop()
    words = [t for t in solid if t.kind != "blank"]
    if words and words[-1].plain == "{" and len(words) > 1 and "=" not in bare:
        return True
    fresh = False  # within = new ..., up to its brace or the end of the statement
    for i, t in enumerate(solid):
        before = [x for x in solid[max(0, i - 2) : i] if x.kind != "blank" or len(x.raw) > 1]
        owner = before[-1].plain if before else ""
        if t.plain == "{":
            if (owner == ")" and not fresh) or owner in ("else", "do"):
                return True
            fresh = False
        elif t.plain == ";":
            fresh = False
        elif t.plain == "new" and [x.plain for x in solid[:i] if x.kind != "blank"][-1:] == ["="]:
            fresh = True
    return False


def spaced(line: str) -> str:
    """The line with the blanks that its operators, separators and conditions lack; literals and comments stay."""
    head = re.match(r'\s*<pre class="code-wrapper[^>]*>(?:<code>)?', line)
    start = head.end() if head else 0
    tokens = statement(line[start:])
    if tokens is None:
        return line
    wanted = {id(left) for left, _, _ in _gaps(tokens)}
    return line[:start] + "".join(t.raw + " " * (id(t) in wanted) for t in tokens)


def tidy(line: str) -> list[str]:
    """A code line repaired: a brace that ends a condition gets a line of its own, with the same indent, and operators get blanks.

    A carriage return at the end stays on each line.
    """
    end = "\r" if line.endswith("\r") else ""
    body = line.removesuffix("\r")
    kept = body.rstrip(" \t")
    solid = [t for t in lex(kept) if t.kind != "blank"]
    if len(solid) > 1 and solid[-1].plain == "{" and solid[-2].plain in (")", "else", "do"):
        indent = body[: len(body) - len(body.lstrip(" \t"))]
        return [spaced(kept[:-1].rstrip(" \t")) + end, indent + "{" + end]
    return [spaced(body) + end]
