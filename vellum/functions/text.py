"""Text, path and number expressions.  All are built-in column expressions and stay in whole-stage codegen.

Patterns follow Java; where letters beyond ASCII count as word characters, the
pattern says (?U).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMENT = r"(?s)<!--(.*?)-->"
TAG = r"<[^>]+>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def q(pattern: str) -> Column:
    return F.lit(pattern)


def first(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one (an empty group is an empty text)."""
    c = col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def every(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of each match, in order."""
    return F.regexp_extract_all(col(c), q(pattern), F.lit(group))


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def numbered(c: Column | str, pattern: str, group: int = 0) -> Column:
    """Array of struct(nr, text): the 1-based line on which each match begins, and its group."""
    c = col(c)
    whole, texts, gaps = every(c, pattern, 0), every(c, pattern, group), F.split(c, pattern, -1)
    # one pass over gaps and matches in turn, with the line reached so far
    step = lambda a, x: F.struct(
        (a["line"] + newlines(x["gap"]) + newlines(F.coalesce(x["whole"], F.lit("")))).alias("line"),
        F.when(x["whole"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct((a["line"] + newlines(x["gap"])).alias("nr"), x["text"].alias("text"))))).alias("out"),
    )
    start = F.struct(F.lit(1).alias("line"), F.expr("cast(array() as array<struct<nr:int,text:string>>)").alias("out"))
    return F.aggregate(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), texts.alias("text")), start, step, lambda a: a["out"])


def without_comments(c: Column | str) -> Column:
    return F.regexp_replace(col(c), COMMENT, "")


def blank_comments(c: Column | str) -> Column:
    """Without comments, but with their line ends, so that line numbers stay."""
    parts = F.split(col(c), r"(?=<!--)|(?<=-->)", -1)
    kept = F.transform(parts, lambda p: F.when(p.rlike(r"(?s)^<!--.*-->$"), F.regexp_replace(p, r"[^\n]", "")).otherwise(p))
    return F.array_join(kept, "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def strip(c: Column | str) -> Column:
    """Without white space, line ends included, at both ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def strip_tags(c: Column | str, by: str = " ") -> Column:
    """Plain text of markup: tags out, white space folded."""
    return squeeze(F.regexp_replace(col(c), TAG, by))


def decode_basic(c: Column | str) -> Column:
    """The five basic entities, the ampersand last."""
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, col(c))


def escape(c: Column | str, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;")] * quotes
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, col(c))


def title(c: Column | str, default: str = "") -> Column:
    """The first h1, else the title, else the default; as plain text."""
    c = col(c)
    one = lambda tag: F.nullif(strip_tags(F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), ""), F.lit(""))
    return F.coalesce(one("h1"), one("title"), F.lit(default))


def truncate(c: Column | str, width: int = 70, tail: str = "...") -> Column:
    """Cut after a whole word so that text and tail fit the width."""
    c = col(c)
    room = width - len(tail)
    cut = F.regexp_replace(F.substring(c, 1, room + 1), r"\s+\S*$", "")
    return F.when(F.length(c) <= width, c).otherwise(F.concat(cut, F.lit(tail)))


def slug(c: Column | str) -> Column:
    """Lower case, runs of other than a-z and 0-9 to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def kebab(c: Column | str) -> Column:
    """A hyphen before each capital or digit but the first character; then lower case."""
    return F.lower(F.regexp_replace(col(c), "(?<!^)(?=[A-Z0-9])", "-"))


def kebab_words(c: Column | str) -> Column:
    """A hyphen between a small letter or digit and a capital; then lower case."""
    return F.lower(F.regexp_replace(col(c), "(?<=[a-z0-9])(?=[A-Z])", "-"))


def identifier(c: Column | str) -> Column:
    """Only letters, digits, hyphen and underscore; a letter first, else with prefix q-."""
    clean = F.regexp_replace(col(c), "[^A-Za-z0-9_-]", "-")
    return F.when(clean.rlike("^[A-Za-z]"), clean).otherwise(F.concat(F.lit("q-"), clean))


def safe_name(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)[^\w.-]+", "_")


def same_text(a: Column | str, b: Column | str) -> Column:
    """Equal but for white space; null counts as empty."""
    fold = lambda x: squeeze(F.coalesce(col(x), F.lit("")))
    return fold(a) == fold(b)


def same_value(a: Column, a_kind: Column, b: Column, b_kind: Column) -> Column:
    """Equality of JSON scalars given as text with their kinds.

    Booleans equal only booleans.  A number equals a number or a text that reads as
    the same number.  Otherwise kinds and texts must agree; null equals null.
    """
    flag = (a_kind == "boolean") | (b_kind == "boolean")
    number = (a_kind == "number") | (b_kind == "number")
    nulls = (a_kind == "null") | (b_kind == "null")
    return (
        F.when(nulls, a_kind == b_kind)
        .when(flag, (a_kind == b_kind) & a.eqNullSafe(b))
        .when(number, F.coalesce(a.try_cast("double") == b.try_cast("double"), F.lit(False)))
        .otherwise((a_kind == b_kind) & a.eqNullSafe(b))
    )


def json_kind(c: Column) -> Column:
    """boolean, number, string, null, array or object, of a JSON scalar's source text."""
    t = F.trim(c)
    return F.when(t.isNull() | (t == "null"), "null").when(t.isin("true", "false"), "boolean").when(t.rlike(r"^-?\d"), "number").when(t.startswith('"'), "string").when(t.startswith("["), "array").otherwise("object")


def invisible(c: Column | str) -> Column:
    """Whether nothing but white space, zero-width signs and no-break spaces is there."""
    return F.regexp_replace(col(c), r"(?U)[\s\x{00A0}\x{200B}-\x{200F}\x{2060}\x{FEFF}]+", "") == ""


def without_private_glyphs(c: Column | str) -> Column:
    """Without private-use code points, as symbol fonts leave behind."""
    return F.regexp_replace(col(c), r"[\x{E000}-\x{F8FF}]", "")


def shift_headings(c: Column | str, by: int = 1, cap: int = 6) -> Column:
    """h2 to h3 and so on, at most the cap; the deepest first, so none moves twice."""
    c = col(c)
    for level in range(cap - 1, 1, -1):
        c = F.regexp_replace(c, rf"(?i)(</?h){level}\b", f"$1{min(cap, level + by)}")
    return c


def prefix_ids(c: Column | str, prefix: Column | str) -> Column:
    """Ids and the anchors to them get a prefix; the prefix may be a column."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    c = F.regexp_replace(col(c), F.lit(r'\bid="([^"]+)"'), F.concat(F.lit('id="'), p, F.lit('-$1"')))
    return F.regexp_replace(c, F.lit(r'\bhref="#([^"]+)"'), F.concat(F.lit('href="#'), p, F.lit('-$1"')))


def letter(n: Column) -> Column:
    """a, b, c, ... of 0, 1, 2, ..."""
    return F.char(F.lit(97) + n)


def row_values(c: Column | str) -> Column:
    """Values of a table row: split at bars if there are any, else each of the bits."""
    c = F.trim(col(c))
    return F.when(c.contains("|"), F.transform(F.split(c, r"\|", -1), lambda x: F.trim(x))).otherwise(F.filter(F.split(F.regexp_replace(c, "[^01]", ""), ""), lambda x: x != ""))


def label_value(c: Column | str) -> Column:
    """struct(label, value) of `label: value`, null for other lines."""
    c = col(c)
    return F.when(c.rlike(r"^[^:]+:\s*\S"), F.struct(F.trim(F.regexp_extract(c, r"^([^:]+):", 1)).alias("label"), F.trim(F.regexp_extract(c, r"^[^:]+:(.*)$", 1)).alias("value")))


def academic_year(d: Column | str) -> Column:
    """The year in which the academic year of a date begins; it begins in September."""
    d = col(d)
    return F.year(d) - F.when(F.month(d) >= 9, 0).otherwise(1)


# ---------------------------------------------------------------- paths


def fold_path(c: Column) -> Column:
    """Empty and . segments out, .. folded with what precedes it; leading .. stay; '.' if nothing is left."""
    parts = F.filter(F.split(c, "/"), lambda s: ~s.isin("", "."))
    folded = F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(folded, "/")
    return F.when(c.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))


def unquote(c: Column) -> Column:
    """Percent decoding that leaves + alone and a broken sequence as it is."""
    return F.coalesce(F.try_url_decode(F.replace(F.replace(c, F.lit("+"), F.lit("%2B")), F.lit("%%"), F.lit("%25%"))), c)


def url_path(url: Column | str) -> Column:
    """The path part of a link: no scheme and host, query, fragment."""
    c = F.regexp_replace(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    c = F.when(c.startswith("//"), F.regexp_replace(c, r"^//[^/?#]*", "")).otherwise(c)
    return F.regexp_replace(c, r"(?s)[?#].*$", "")


def parent(path: Column | str) -> Column:
    """The folder of a path, '' at the top."""
    return F.regexp_replace(col(path), r"/?[^/]*$", "")


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    """The last extension in lower case with its dot, else ''."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def local_target(page: Column | str, url: Column | str) -> Column:
    """The path from the root that a link on a page leads to; null if the link has no path."""
    path = unquote(url_path(url))
    joined = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.nullif(parent(page), F.lit("")), path))
    return F.when(path != "", fold_path(joined))


def depth_glob(path: Column | str, name: str, depths: tuple[int, ...]) -> Column:
    """A file of this name so many folders deep; no folder crosses a slash."""
    return (basename(path) == name) & (F.size(F.split(col(path), "/")) - 1).isin(*depths)


def glob_regex(pattern: str) -> str:
    """Shell pattern to regular expression; * and ? cross slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            inner = pattern[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def any_glob(path: Column | str, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (col(path).rlike(glob_regex(p)) for p in patterns), F.lit(False))


def has_part(path: Column | str, names: list[str], folders_only: bool = False) -> Column:
    """Whether a part of the path is one of the names; folders_only leaves the file name out."""
    parts = F.split(col(path), "/")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1) if folders_only else parts
    return F.arrays_overlap(parts, F.array(*map(F.lit, names))) if names else F.lit(False)


# ---------------------------------------------------------------- measures


def emu_to_mm(c: Column) -> Column:
    return c / F.lit(36000.0)


def twips_to_mm(c: Column) -> Column:
    return c * F.lit(25.4 / 1440)


def png_size(content: Column) -> Column:
    """struct(width, height) from the header of a PNG, null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def svg_size(text: Column) -> Column:
    """struct(width, height) in pixels: the attributes, else the view box."""
    root = F.regexp_extract(text, r"(?is)<svg\b[^>]*>", 0)
    number = lambda name: F.nullif(F.regexp_extract(root, rf'(?i)\b{name}="([0-9.]+)(?:px)?"', 1), F.lit("")).cast("double")
    box = F.split(F.trim(F.regexp_extract(root, r'(?i)\bviewBox="([^"]*)"', 1)), r"[\s,]+")
    return F.struct(F.coalesce(number("width"), F.get(box, F.lit(2)).try_cast("double")).alias("width"), F.coalesce(number("height"), F.get(box, F.lit(3)).try_cast("double")).alias("height"))


def figure_cm(pixels: Column, wanted_cm: Column | None = None, dpi: int = 96, cap: float = 15.0) -> Column:
    """Width of a figure: the wanted one, else its natural one; at most the cap."""
    natural = pixels / dpi * 2.54
    return F.least(F.coalesce(wanted_cm, natural) if wanted_cm is not None else natural, F.lit(cap))


def target_pixels(natural: Column, width_mm: Column, dpi: int) -> Column:
    """Pixels that a figure of this width needs at dpi; never enlarged; natural if dpi is 0."""
    return natural if not dpi else F.least(natural, F.ceil(width_mm / 25.4 * dpi).cast("int"))
