"""Expressions and kernels on hand-made values."""

import pytest
from pyspark.sql import functions as F

from vellum import conf
from vellum.functions import kernels as k
from vellum.functions import text as tx


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t}" for n, t in ((n, {int: "int", float: "double", bytes: "binary"}.get(type(v), "string")) for n, v in values.items())))


def value(df, c):
    return df.select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("page", "url", "want"),
    [
        ("a/b.html", "c.html", "a/c.html"), ("a/b.html", "../c.html?x#y", "c.html"), ("a/b.html", "../../c.html", "../c.html"), ("b.html", "#x", None), ("b.html", "c%20d.html", "c d.html"),
        ("b.html", "a+b.html", "a+b.html"), ("b.html", "./x/./y/../z.png", "x/z.png"), ("b.html", "/x/y", "/x/y"), ("b.html", "100%.html", "100%.html"), ("a/b.html", "..", "."),
    ],
)
def test_local_target(spark, page, url, want):
    assert value(one(spark, p=page, u=url), tx.local_target("p", "u")) == want


@pytest.mark.parametrize(
    ("text", "pattern", "group", "want"),
    [("a\nb x\n\nx", "x", 0, [(2, "x"), (4, "x")]), ("<b\n>\n<b>", r"<b(\s*)>", 1, [(1, "\n"), (3, "")]), ("abc", "z", 0, []), ("x\n", "x\n", 0, [(1, "x\n")]), ("xx\nx", "(x)", 1, [(1, "x"), (1, "x"), (2, "x")])],
)
def test_numbered(spark, text, pattern, group, want):
    assert [(r["nr"], r["text"]) for r in value(one(spark, t=text), tx.numbered("t", pattern, group))] == want


def test_text_expressions(spark):
    df = one(spark, t="  <p>Zoë &amp; <b>co</b>\n x</p> ", w="EenTweeDrie4", n=None or "", s="Ünï Cödé!")
    assert value(df, tx.strip_tags("t")) == "Zoë &amp; co x"
    assert value(df, tx.kebab("w")) == "een-twee-drie-4" and value(df, tx.kebab_words("w")) == "een-twee-drie4"
    assert value(df, tx.slug("s")) == "n-c-d" and value(df, k.ascii_slug_udf("s")) == "uni-code"
    assert value(df, k.without_accents_udf("s")) == "Uni Code!" and value(df, k.pascal_udf("s")) == "UniCode"
    assert value(df, tx.identifier(F.lit("4 x"))) == "q-4-x" and value(df, tx.safe_name(F.lit("a b/ë.txt"))) == "a_b_ë.txt"
    assert value(df, tx.title(F.lit("<h1></h1><title>T</title>"), "d")) == "T" and value(df, tx.title(F.lit(""), "d")) == "d"
    assert value(df, tx.truncate(F.lit("aaa bbb ccc"), 9)) == "aaa..." and value(df, tx.truncate(F.lit("abc"), 9)) == "abc"
    assert value(df, tx.shift_headings(F.lit("<h2>a</h2><h5>b</h5><h6>c</h6>"))) == "<h3>a</h3><h6>b</h6><h6>c</h6>"
    assert value(df, tx.prefix_ids(F.lit('<a id="x"><b href="#x">'), "p")) == '<a id="p-x"><b href="#p-x">'
    assert value(df, tx.blank_comments(F.lit("a<!-- x\ny\n -->b"))) == "a\n\nb"
    assert value(df, tx.invisible(F.lit(" ​ "))) and not value(df, tx.invisible(F.lit(" x")))
    assert value(df, tx.without_private_glyphs(F.lit("ab"))) == "ab"
    assert value(df, tx.row_values(F.lit("a | b|c"))) == ["a", "b", "c"] and value(df, tx.row_values(F.lit("01 1"))) == ["0", "1", "1"]
    assert value(df, tx.label_value(F.lit("x y: 3 4"))) == ("x y", "3 4") and value(df, tx.label_value(F.lit("xy"))) is None
    assert value(df, tx.same_text(F.lit(" a  b"), F.lit("a b "))) and value(df, tx.letter(F.lit(2))) == "c"


@pytest.mark.parametrize(
    ("a", "ka", "b", "kb", "want"),
    [("9.99", "string", "9.990", "number", True), ("true", "boolean", "1", "number", False), ("true", "boolean", "true", "boolean", True), (None, "null", None, "null", True), (None, "null", "0", "number", False), ("a", "string", "a", "string", True), ("x", "string", "3", "number", False)],
)
def test_same_value(spark, a, ka, b, kb, want):
    df = spark.createDataFrame([(a, ka, b, kb)], "a string, ka string, b string, kb string")
    assert value(df, tx.same_value(F.col("a"), F.col("ka"), F.col("b"), F.col("kb"))) is want


def test_measures(spark):
    png = bytes.fromhex("89504E470D0A1A0A") + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (48).to_bytes(4, "big")
    df = one(spark, p=png, s='<svg width="12px" height="3"><rect/></svg>', v='<svg viewBox="0 0 7 9">')
    assert value(df, tx.png_size(F.col("p"))) == (640, 48) and value(df, tx.png_size(F.col("s").cast("binary"))) is None
    assert value(df, tx.svg_size(F.col("s"))) == (12.0, 3.0) and value(df, tx.svg_size(F.col("v"))) == (7.0, 9.0)
    assert value(df, tx.target_pixels(F.lit(500), F.lit(25.4), 100)) == 100 and value(df, tx.target_pixels(F.lit(50), F.lit(25.4), 100)) == 50


def test_globs(spark):
    df = spark.createDataFrame([("a/b/c.html",), ("a/c.html",), ("x.htm",)], "p string")
    hits = lambda c: [r["p"] for r in df.where(c).collect()]
    assert hits(tx.any_glob("p", ["a/*.html"])) == ["a/b/c.html", "a/c.html"] and hits(tx.any_glob("p", ["[!a]*"])) == ["x.htm"]
    assert hits(tx.depth_glob("p", "c.html", (2,))) == ["a/b/c.html"] and hits(tx.has_part("p", ["b"], folders_only=True)) == ["a/b/c.html"] and hits(tx.has_part("p", [])) == []


CODE = [
    ("int a=1;", "int a = 1;"), ("if(a==b&&c){", "if (a == b && c){"), ('s="a=b";', 's = "a=b";'), ("x+=1;", "x+=1;"), ("List&lt;int&gt; a;", "List&lt;int&gt; a;"), ("Map<string,List<int>> m;", "Map<string,List<int>> m;"),
    ("f(a,b);", "f(a, b);"), ("p->x=a<<2;", "p->x = a<<2;"), ("for(i=0;i&lt;n;i++){", "for (i = 0; i &lt; n; i++){"), ("#include <a.h>", "#include <a.h>"), ("a=1 // b=2", "a=1 // b=2"), ("a=1; // b=2", "a = 1; // b=2"), ("a = b;", "a = b;"), ("return -1;", "return -1;"),
]


@pytest.mark.parametrize(("before", "after"), CODE)
def test_spacing(before, after):
    assert k.spaced(before) == after and k.spaced(after) == after
    assert not (k.tight_operators(after) and "<string,List" not in after and "f(" not in after and "p->" not in after) or k.tight_operators(after) == k.tight_operators(before)


def test_lists_and_names():
    html = '<ol class="vragen"><li>a<ul><li>b</li><li class="juist">c</li></ul></li><li>d</li></ol><ol class="vragen" start="3"><li>e</li></ol><ol><li>f</li></ol>'
    got = k.question_lists(html)
    assert [(q["begin"], q["declared"], q["expected"], len(q["items"])) for q in got] == [(1, False, 1, 2), (3, True, 3, 1)]
    assert [b for _, b in k.list_items(got[0]["items"][0]["body"], "ul")] == ["b", "c"] and k.list_items("no list", "ul") == []
    assert [o["body"] for o in k.objectives('<h2 id="doelstellingen">x</h2><ol><li>a</li></ol><h2>y</h2><ol><li>b</li></ol>')] == ["a"]
    assert k.unclosed_comments("<!-- a\n<!-- b --> <!--") == [1, 2]
    assert k.parse_name("Test labo A en B (!)", "A", ["A", "B"]) == ("test", None) and k.parse_name("Test labo B en A (!)", "A", ["A", "B"])[0] is None
    assert k.parse_name("Verslag A: Deel 2", "A", ["A"]) == ("report", "Deel 2") and k.parse_name("Opdracht A: deel (!)", "A", ["A"])[0] is None
    assert k.name_series("A en B en C", ["A", "A en B", "B", "C"]) in (["A", "B", "C"], ["A en B", "C"])
    assert k.collision_names(["x.png"] * 3 + ["x-2.png"]) == ["x.png", "x-2.png", "x-2-3.png", "x-2-2.png"]
    assert k.collision_names(["a.png", "A.png", "a.PNG", ".x", "b"], taken=["B"]) == ["a.png", "A-2.png", "a-2-3.PNG", ".x", "b-2"]
    assert k.longest_run("a b c d".split(), "x b c d a b".split()) == (1, 3)
    assert k.list_items("<ul><li>a<ol><li>b</li></ol></li><li>open</ul>", "ol") == [("<li>", "b")] and k.list_items("<ul><li>a</li><li>open</ul>", "ul") == [("<li>", "a")]
    assert k.blanks_without_class('<ol class="vragen"><li>invulruimte</li></ol><ul><li><ol><li>x</li></ol></li></ul>') is False and k.blanks_without_class("<ul><li><ol><li>invulruimte</li></ol></li></ul>")
    assert k.to_xhtml("<p>a<foo>b<br>&lt;</p></x>") == {"xhtml": "<p>ab<br/>&lt;</p>", "unwrapped": ["foo"]} and k.well_formed("<a>") and not k.well_formed("<a/>")


BLOCK = '<div class="x solution-container"><div>x</div></div>'


@pytest.mark.parametrize(
    ("before", "after"),
    [
        (f"a<h2>Oplossing</h2> {BLOCK}b", "ab"), (f"a<h4> OPLOSSING\n</h4>{BLOCK}b{BLOCK}c", "abc"),
        (f"a<h3>Oefening 3</h3>{BLOCK}b", "a<h3>Oefening 3</h3>b"),  # another heading stays
        (f"<h2>Oplossing</h2><p>x</p>{BLOCK}", "<h2>Oplossing</h2><p>x</p>"),  # so does one that is not right before the block
        (f"<h2 id='{'i' * 200}'>Oplossing</h2>{BLOCK}b", f"<h2 id='{'i' * 200}'>Oplossing</h2>b"),  # or begins too far before it
        ('a<div class="solution-container"><div>x</div><p>kept</p>', "a<p>kept</p>"),  # never closed: up to the last div tag
        ("no block", "no block"), ("", ""),
    ],
)
def test_dropped_solutions(before, after):
    assert k.drop_blocks(before) == after


@pytest.mark.parametrize(
    ("line", "shared", "lines"),
    [
        ("  if (a) {", True, ["  if (a)", "  {"]), ("} else{", True, ["} else", "{"]), ("do {", True, ["do", "{"]), ("{", False, ["{"]), ("int a[] = {", False, ["int a[] = {"]),
        ("x = new List&lt;int&gt;() { 1 };", False, ["x = new List&lt;int&gt;() { 1 };"]), ("if (a) { b(); }", True, ["if (a) { b(); }"]), ("struct s {", True, ["struct s {"]),
        ("// if (a) {", False, ["// if (a) {"]), ("if(a) {\r", True, ["if (a)\r", "{\r"]), ("a=1;\r", False, ["a = 1;\r"]),
    ],
)
def test_braces(line, shared, lines):
    from vellum.functions.lexer import shared_brace, tidy

    assert shared_brace(line.rstrip()) is shared and tidy(line) == lines


@pytest.mark.parametrize(
    ("line", "names"),
    [
        ("int a=1;", ["="]), ("for(i=0;i&lt;n;i++)", ["=", "comparison", ";", "keyword("]), ("a &amp;&amp;b;", ["&&/||"]), ("0,17 Hz", []), ("x == y; // a=b", []), ("<b>x=1;", []),
        ("Map&lt;string, List&lt;int[]&gt;&gt; m;", []), ("a&lt;b &amp;&amp; c&gt;d;", ["comparison"]), ("x += 1; p->q; a << 1; i++;", []), ("x=>y;", ["=", "comparison"]), ('s = "a=b,c";', []), ("f(-1,-2);", [","]),
    ],
)
def test_tight_operators(line, names):
    assert k.tight_operators(line) == names


def test_squeezed_looks_into_strings():
    from vellum.functions.lexer import squeezed

    assert squeezed('s = "a=b"') and squeezed("a==b") and not squeezed("a =b") and not squeezed("a=>b") and not squeezed("a ==b") and not squeezed("=")


def test_configuration():
    got = conf.merge(conf.DEFAULTS, {"_note": 1, "check": {"disable": {"x": "y"}, "skip_pages": ["a"]}})
    assert got["check"]["disable"] == {"x": "y"} and got["check"]["orphan_roots"] == ["Labo"]
    for bad in ({"nope": 1}, {"check": {"skip_pages": "a"}}, {"check": 3}, {"check": {"disable": []}}, []):
        with pytest.raises(conf.ConfigError):
            conf.merge(conf.DEFAULTS, bad)


def test_numbers_of_names_are_collision_names():
    """Wishes that are links of each other's chains, in any case, against the names written out."""
    import random

    assert k.chain("x-2-3") == ("x", 3) and k.chain("x-3") == ("x-3", 1) and k.chain("x-2-02") == ("x-2-02", 1) and k.chain("-2") == ("", 2) and k.chain_root("x-2-2-3") == "x"
    assert k.chain("x-" + "9" * 5000) == ("x-" + "9" * 5000, 1)
    rng = random.Random(5)
    for _ in range(400):
        wishes = [rng.choice("xXyß") + "".join(rng.choice(["-2", "-3", "-2-3", "-4", ""]) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(40))]
        by_root, got = {}, []
        for w in wishes:
            stem, n = by_root.setdefault(k.chain_root(w.lower()), k.Numbers()).name(w)
            assert k.chain(stem + "".join(f"-{i}" for i in range(2, n + 1))) == (stem, n)
            got.append(stem + "".join(f"-{i}" for i in range(2, n + 1)))
        assert got == k.collision_names(wishes)
    many, numbers = 200_000, k.Numbers()
    assert [numbers.name("x") for _ in range(many)][-1] == ("x", many)  # written out, these names have 120 GB
