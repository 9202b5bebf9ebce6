"""The tag stream, rewrites by spans, and the transforms built on them, with look-alikes."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import tokens
from vellum.operators import assemble, rewrite
from vellum.sources.package import locate


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<a href="x>y">t</a>', ["a", "/a"]),
        ("<!-- <a> --><b/><!doctype html>", ["b"]),
        ("<script>if (a<b) '<p>'</script><p>", ["script", "/script", "p"]),
        ("a < b <3 <- <a", []),
        ("<!-- open <a>", []),
        ("<TITLE><h1></TITLE><H1 a='>'>", ["title", "/title", "h1"]),
        ("<style>p>a{}", ["style"]),
    ],
)
def test_tags(page, want):
    assert [("/" if t.close else "") + t.name for t in tokens.tags(page)] == want


def test_attributes_and_spans():
    page = "x<IMG alt='a \"b\"' SRC = \"u&amp;v\" data-src=w src=z hidden>"
    (t,) = tokens.tags(page)
    assert (t.get("src"), t.get("alt"), t.get("data-src"), t.get("hidden"), t.get("no", "-")) == ("u&v", 'a "b"', "w", "", "-")
    a = t.attributes["src"]
    assert page[a.begin : a.end] == "u&amp;v" and page[t.begin : t.end] == page[1:]


def test_spans_leave_the_rest():
    rng = random.Random(1)
    for _ in range(300):
        page = "".join(rng.choice("ab<>/\"' \n=é😀") for _ in range(60))
        assert tokens.spliced(page, [(t.begin, t.end, page[t.begin : t.end]) for t in tokens.tags(page)]) == page
    assert tokens.spliced("abcdef", [(1, 4, "X"), (2, 3, "Y"), (5, 6, "")]) == "aXe"


def test_elements_nest():
    page = "<div>a<div>b</div></div></div><div>"
    assert [(page[slice(*e.inner)], e.closed) for e in tokens.elements(page, ("div",))] == [("a<div>b</div>", True), ("b", True), ("", False)]


def test_scripts():
    note = tokens.TEXTS.interactive
    cases = {"<script>draw()</script>": note, "<script src='a.js'>x</script>": "", "<script> \n</script>": "", "<script>initChecklistSync('x');</script>": "", "<script>initChecklistSync('x'); draw()</script>": note, "<script>x": "<script>x", '<div class="widget">w</div>': '<div class="widget">w</div>', "<!-- <script>x</script> -->": "<!-- <script>x</script> -->"}
    for page, want in cases.items():
        assert tokens.without_scripts(f"é{page}é") == {"html": f"é{want}é", "notes": int(want == note)}


def test_frames():
    out = tokens.frames_to_links('<iframe title="My \'t&amp;c\'" src="https://player.vimeo.com/1?a=1&amp;b=2" /></iframe>')
    assert out == '<div class="pdf-note"><strong>Video.</strong> My &#x27;t&amp;c&#x27;<br><a href="https://player.vimeo.com/1?a=1&amp;b=2">https://player.vimeo.com/1?a=1&amp;b=2</a></div></iframe>'
    assert tokens.frames_to_links('<iframe src="/d2l/x"></iframe><b>') == tokens.TEXTS.on_platform + "<b>"
    assert tokens.frames_to_links("<iframe></iframe>") == '<div class="pdf-note"><strong>Embedded page.</strong><br><a href=""></a></div>'


def test_printable():
    page = '<head><title>x</title></head><body><script>s</script><div class="container"><h1>T</h1>\n <p>intro</p><p class="lead">stays</p><div class="download-container x"><ul><li><div></div></li></ul></div><h1>second</h1><a href="y"><b>l</b></a><p><a href="f.pdf">doc</a></p></div></body>'
    assert tokens.printable(page) == {"html": '<div class="container"><p class="lead">stays</p><h1>second</h1><b>l</b><p>doc</p></div>', "error": None}
    assert tokens.printable("<h1>T</h1>")["error"] == "no body" and tokens.printable("<body><!-- <h1>T</h1> --></body>")["error"] == "no h1"
    assert tokens.printable("<body><h1>T</h1> text <p>stays</p></body>")["html"] == "text <p>stays</p>"


def test_references(spark):
    page = "<a href=\"x\">x</a><!-- <a href=\"x\"> --><img src='x'><a href=x>href=\"x\"</a><script>'href=\"x\"'</script>"
    pages = spark.createDataFrame([("p", page), ("q", None), ("r", "none")], "path string, html string")
    new = spark.createDataFrame([("p", "x", "a'b&\"c")], "path string, ref string, new string")
    got = {r["path"]: r["html"] for r in rewrite.rewrite_references(pages, new).collect()}
    safe = "a&#39;b&amp;&quot;c"
    assert got == {"p": f"<a href=\"{safe}\">x</a><!-- <a href=\"x\"> --><img src='{safe}'><a href=\"{safe}\">href=\"x\"</a><script>'href=\"x\"'</script>", "q": None, "r": "none"}


def test_images(spark):
    pages = spark.createDataFrame([("d/p.html", '<img src="a%20b.png"><img alt="A&amp;B" src="../no.png"><img src="http://x/y.png"><img src="">')], "path string, html string")
    got = rewrite.images_or_placeholder(pages, spark.createDataFrame([("d/a b.png",)], "path string"), root="/r/").first()
    assert got["html"] == '<img src="/r/d/a b.png"><div class="pdf-missing-img"><strong>Image missing</strong><br>A&amp;B</div><img src="http://x/y.png"><img src="">'
    assert got["missing"] == ["no.png"]


def test_locate(spark):
    entries = [("p", e) for e in ("Labo1/Img/a b.png", "labo1/c.png", "x/dup.png", "y/dup.png", "q/z/only.png", "top.png")]
    asked = {
        ("img/a%20b.png", "labo1"): "Labo1/Img/a b.png", ("../LABO1/C.png", "other"): "labo1/c.png", ("/content/enforced/12-x/labo1/c.png", "any"): "labo1/c.png", ("/labo1/c.png?x#y", ""): "labo1/c.png",
        ("dup.png", "x"): "x/dup.png", ("dup.png", "nowhere"): None, ("z/only.png", "n"): "q/z/only.png", ("gone/only.png", "n"): "q/z/only.png", ("", "x"): None, ("#a", "x"): None, ("../../top.png", "a"): "top.png", ("ly.png", ""): None,
    }
    refs = spark.createDataFrame([("p", r, b) for r, b in asked] + [("p", "top.png", None), ("none", "top.png", "")], "k string, ref string, base string")
    got = {(r["k"], r["ref"], r["base"]): r["found"] for r in locate(refs, spark.createDataFrame(entries, "k string, entry string"), "k", "ref", "base").collect()}
    assert got == {("p", *k): v for k, v in asked.items()} | {("p", "top.png", None): "top.png", ("none", "top.png", ""): None}


def test_header_reason(spark):
    cell = lambda k, row, col, bold=False, header=False, text="x": (k, row, col, bold, header, text)
    rows = [cell("bold", 0, 0, True)] + [cell("all", r, 0, True) for r in range(3)] + [cell("flag", 0, 0, header=True), cell("late", 0, 0), cell("late", 0, 1), cell("late", 1, 0, header=True)]
    rows += [cell("empty", 0, 0, text=" "), cell("part", 0, 0, True), cell("part", 0, 1), cell("gap", 0, 0, True), cell("gap", 0, 1, text="")]
    rows += [cell("style", r, c) for r in range(3) for c in range(2)] + [cell("short style", r, c) for r in range(2) for c in range(2)]
    df = spark.createDataFrame(rows, "k string, row int, col int, all_bold boolean, header boolean, text string")
    got = {r["k"]: (r["is_header"], r["reason"]) for r in assemble.header_reason(df, ["k"], F.col("k").contains("style")).collect()}
    assert got == {"bold": (True, "bold"), "all": (True, "bold"), "flag": (True, "flag"), "late": (False, "no signal"), "empty": (False, "one column"), "part": (False, "no signal"), "gap": (True, "bold"), "style": (True, "style"), "short style": (False, "no signal")}


def test_slide_numbers(spark):
    deck = '<section class="slide a" data-slide="7">x</section><section data-nr="5" class="slide">n</section><section class="slide" data-nr="5">y</section>'
    got = [(r["pos"], r["number"]) for r in assemble.slides(spark.createDataFrame([("d", deck)], "path string, html string")).orderBy("pos").collect()]
    assert got == [(1, 7), (2, 2)]


def test_segments():
    from vellum.functions.segments import segments

    got = lambda x: [(s["text"], s["styles"]) for s in segments(x)]
    assert got("typ <code>ls</code> en") == [("typ ", []), ("ls", ["code"]), (" en", [])]
    assert got("typ <code> ls </code> en ") == [("typ ", []), ("ls ", ["code"]), ("en", [])]
    assert got(" <b>a<i>b</b>c</i> <b> </b>") == [("a", ["vet"]), ("b", ["cursief", "vet"]), ("c", [])]
    assert got("a&lt;b&nbsp;<strong>x</strong><script><b>no</b></script><!-- <b>no</b> -->y") == [("a<b ", []), ("x", ["vet"]), ("y", [])]
    assert got("a<!-- c --> b") == [("a", []), (" b", [])] and got("") == got(" <b> </b> ") == [] and got("</b>x<br/>y") == [("x", []), ("y", [])]
