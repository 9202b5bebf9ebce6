"""Operators against hand-made expectations and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.corpus import from_dict
from vellum.operators import answers, assemble, menu, privacy, reconcile, repair, rewrite, runs, sequence
from vellum.plans.runner import findings


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_as_of_and_ranges(spark):
    rng = random.Random(1)
    left = [(rng.randrange(3), rng.randrange(50), i) for i in range(80)]
    right = [(rng.randrange(3), rng.randrange(50), i) for i in range(25)]
    L, R = spark.createDataFrame(left, "k int, at int, id int"), spark.createDataFrame(right, "k int, start int, v int")
    want = [(k, at, i, max(((s, v) for kk, s, v in right if kk == k and s <= at), default=(None, None))[1]) for k, at, i in left]
    assert rows(sequence.as_of(L, R, ["k"], "at", "start", ["v"]).select("k", "at", "id", F.coalesce("v", F.lit(-1)))) == sorted((*w[:3], -1 if w[3] is None else w[3]) for w in want)
    ranges = [(rng.randrange(3), s, s + rng.randrange(30), i) for i, s in enumerate(rng.randrange(40) for _ in range(20))]
    G = spark.createDataFrame(ranges, "k int, lo int, hi int, r int")
    want = sorted((i, r) for k, at, i in left for kk, lo, hi, r in ranges if k == kk and lo <= at <= hi)
    assert rows(sequence.in_ranges(L, G, ["k"], "at", "lo", "hi", 7).select("id", "r")) == want


def test_sequences(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabbba")], "k int, o int, x string")
    assert rows(sequence.islands(df, ["k"], ["o"], ["x"], {"n": F.count("*")}).select("island", "x", "n")) == [(1, "a", 2), (2, "b", 3), (3, "a", 1)]
    assert rows(sequence.repeats(df, ["x"], ["o"]).select("o")) == [(1,), (3,), (4,), (5,)]
    heads = spark.createDataFrame([(1, 1, "Een"), (1, 2, "Twee"), (1, 3, "Een")], "k int, o int, h string")
    pages = spark.createDataFrame([(1, 1, "inhoud een twee"), (1, 2, "E e n"), (1, 3, "twee"), (1, 4, "een")], "k int, page int, t string")
    assert rows(sequence.forward_match(heads, pages, ["k"], "o", "h", "page", "t").select("o", "page")) == [(1, 1), (2, 1), (3, 1)]
    ch = spark.createDataFrame([(1, 1, True, False), (1, 2, False, None), (1, 3, True, True), (1, 4, False, None), (1, 5, False, None)], "k int, o int, ch boolean, c boolean")
    got = sequence.chapter_numbers(ch, ["k"], ["o"], F.col("ch"), F.col("c"))
    assert [tuple(r) for r in got.orderBy("o").select("chapter_no", "section_no").collect()] == [(None, None), (None, None), (1, None), (1, 1), (1, 2)]


def test_shared_runs_needs_no_pairs(spark):
    texts = spark.createDataFrame([("m", "a", "x y z w q".split()), ("m", "b", "p x y z w".split()), ("m", "c", "x y q z".split()), ("n", "d", "x y z w".split())], "g string, p string, w array<string>")
    assert [(r["a"]["p"], r["b"]["p"], r["run"]) for r in runs.shared_runs(texts, "g", ["p"], "w", 3).collect()] == [("a", "b", ["x", "y", "z", "w"])]


def test_plan_covers_every_case(spark):
    want = spark.createDataFrame([("p-1", "p#1@a"), ("p-2", "p#2@b"), ("p-3", "p#3@c")], "id string, x string")
    have = spark.createDataFrame([("p-1", "p#1@a"), ("p-2", "p#2@z"), ("p-9", "p#9@q"), ("other-1", "x"), (None, "y")], "id string, x string")
    own = F.col("key" if False else "id").rlike(r"^p-\d+$")
    got = reconcile.plan(want, have, "id", "x", own)
    assert rows(got) == [("p-1", "same"), ("p-2", "changed"), ("p-3", "new"), ("p-9", "orphan")]
    assert rows(reconcile.action_plan(got).select("key", "request")) == [("p-2", "delete"), ("p-2", "post"), ("p-3", "post"), ("p-9", "report")]
    assert not reconcile.ready(got).first()["ready"]
    with pytest.raises(reconcile.ReconcileError, match="p-9"):
        reconcile.raise_if_any(got.where("action = 'orphan'"), "orphans")


def test_settings(spark):
    docs = spark.createDataFrame([(1, '{"_c": 1, "a": 9.99, "b": true, "n": null, "cover": {"x": 1, "_y": 2, "z": "q"}}')], "k int, d string")
    flat = reconcile.flatten_settings(docs, ["k"], "d")
    assert rows(flat.select(F.coalesce("object", F.lit("")), "field", "value")) == [("", "a", "9.99"), ("", "b", "true"), ("cover", "x", "1"), ("cover", "z", "q")]
    d = spark.createDataFrame([(1, None, "a", "9.99", "number"), (1, "g", "p", "1", "number"), (1, "g", "q", "2", "number"), (1, "cover", "x", "1", "number"), (1, "cover", "y", "2", "number")], "k int, object string, field string, value string, kind string")
    a = spark.createDataFrame([(1, None, "a", "9.990", "string"), (1, "g", "p", "1", "number"), (1, "g", "q", "3", "number"), (1, "cover", "x", "1", "number"), (1, "cover", "y", "0", "number")], d.schema)
    assert rows(reconcile.setting_changes(d, a, ["k"]).select("object", "field", "want", "have")) == [("cover", "y", "2", "0"), ("g", "q", "2", "3")]
    more = a.unionByName(spark.createDataFrame([(1, "g", "other", "9", "number"), (1, "cover", "other", "9", "number")], d.schema))
    assert {r["object"]: r["body"] for r in reconcile.settings_plan(d, more, ["k"], ["cover"]).collect()} == {"g": {"p": "1", "q": "2", "other": "9"}, "cover": {"y": "2"}}
    assert {r["object"]: r["body"] for r in reconcile.settings_plan(d, a, ["k"], ["cover"]).collect()} == {"g": {"p": "1", "q": "2"}, "cover": {"y": "2"}}


def test_change_status_and_snapshot(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "code string, hash string")
    before = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "8")], "code string, hash string")
    assert rows(reconcile.change_status(now, before, "code", "hash")) == [("a", "1", ""), ("b", "2", "changed"), ("c", "3", "new")]
    assert {s for *_, s in rows(reconcile.change_status(now, None, "code", "hash"))} == {""}
    assert rows(reconcile.merged_snapshot(now, before, "code")) == [("a", "1"), ("b", "2"), ("c", "3"), ("z", "8")]


def test_decisions(spark):
    df = spark.createDataFrame([("a b", " a  b"), ("a", "c"), ("a", " "), ("a", None)], "p string, t string")
    kind, text = reconcile.decision(F.col("p"), F.col("t"), "FOOT")
    assert [tuple(r) for r in df.select(kind, text).collect()] == [("proposal", " a  b\n\nFOOT"), ("adjusted", "c\n\nFOOT"), ("empty", None), ("empty", None)]


def test_pseudonyms(spark):
    names = ["Zoë van der Berghe", "Jan Ek Li", "O'Neill Anne"]
    df = spark.createDataFrame([("zoë ZOË_x Berghes berghe",), ("Jan jan Janneke",), ("van de li",), ("anne ANNE Anne, neill",)], "t string")
    text, n = privacy.redacted(F.col("t"), privacy.name_patterns(names), "#")
    assert [tuple(r) for r in df.select(text, n).collect()] == [("zoë ZOË_x Berghes #", 1), ("# jan Janneke", 1), ("van de li", 0), ("anne ANNE #, #", 2)]
    big = privacy.redact_large(df, spark.createDataFrame([(n,) for n in names], "name string"), "t", "name", "t", "#")
    assert {r["n_names"] for r in big.where("t like 'anne%'").collect()} == {2}
    import random

    rng = random.Random(4)
    some = ["".join(rng.choice("abcéAB") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = spark.createDataFrame([(i, None if i == 7 else "".join(rng.choice([rng.choice(some), rng.choice(some).upper(), "7", "_"]) + rng.choice(["", " ", "-", "_", "\n", "2"]) for _ in range(30))) for i in range(80)], "i int, t string")
    people = some[:60]
    pattern, count = privacy.redacted(F.col("t"), privacy.name_patterns(people), "#")
    want = {r["i"]: (r["x"], r["n"]) for r in texts.select("i", pattern.alias("x"), count.alias("n")).collect()}
    for bits in (15, 26):  # a full bitmap lets more words through and changes nothing
        large = privacy.redact_large(texts, spark.createDataFrame([(n,) for n in [*people, None, ""]], "name string"), "t", "name", "i", "#", bits)
        assert {r["i"]: (r["redacted"], r["n_names"]) for r in large.collect()} == want
    assert sum(n for _, n in want.values()) > 50
    assert [r["redacted"] for r in big.orderBy("t").collect()] == [r["x"] for r in df.orderBy("t").select(text.alias("x")).collect()]


def test_stable_codes(spark):
    known = spark.createDataFrame([("S01", 50), ("S07", 3)], "code string, id long")
    first = privacy.stable_codes(spark.createDataFrame([(50,), (9,), (4,)], "id long"), known, "id")
    assert rows(first) == [("S01", 50), ("S07", 3), ("S08", 4), ("S09", 9)]
    again = privacy.stable_codes(spark.createDataFrame([(9,), (1,)], "id long"), first, "id")
    assert set(rows(first)) < set(rows(again)) and ("S10", 1) in rows(again)
    assert {len(c) for c, _ in rows(privacy.stable_codes(spark.range(120), known.limit(0), "id"))} == {4}


def test_submissions(spark):
    files = spark.createDataFrame([(1, "docx", "2024-01-01", 0, "a.docx", b"1"), (1, "docx", "2024-02-01", 1, "b.docx", b"2"), (1, "docx", "2024-02-01", 1, "c.docx", b"3"), (1, "image", "2024-01-01", 0, "i.png", b"4"), (1, "docx", "2024-02-01", 2, "d.docx", b"5")], "s int, kind string, date string, ord int, name string, content binary")
    assert rows(privacy.latest_per_kind(files, ["s"], "kind", ["ord"], "date").select("name")) == [("d.docx",), ("i.png",)]
    dup = spark.createDataFrame([(1, 0, "a.docx", b"x"), (1, 1, "b.docx", b"x"), (1, 2, "a.pdf", b"y"), (1, 3, "c.pdf", b"z")], "s int, ord int, name string, content binary")
    ext, stem = F.regexp_extract("name", r"(\.[^.]*)$", 1), F.regexp_extract("name", r"^(.*)\.", 1)
    assert rows(privacy.without_copies(dup, ["s"], ["ord"], "content", "name", stem, ext).select("name")) == [("a.docx",), ("c.pdf",)]
    a = spark.createDataFrame([("s", "docx", "h1"), ("s", "image", "h2")], "c string, k string, h string")
    same = privacy.fingerprint(a, ["c"], "k", "h").first()["hash"]
    assert same == privacy.fingerprint(a.orderBy(F.desc("h")), ["c"], "k", "h").first()["hash"] != privacy.fingerprint(a.limit(1), ["c"], "k", "h").first()["hash"]


def test_repair_is_idempotent_and_satisfies_the_rules(spark):
    html = 'a — b\r\n<pre class="code-wrapper language-c"><code>if(a==1) {\r\nx=1;\r\n</code></pre>\r\n<iframe src="https://www.youtube.com/embed/x"></iframe>\n<script src="../oplossingen.js"></script>\nend'
    c = from_dict(spark, {"a.html": html})
    once = repair.repaired(c).first()
    assert once["html"] == 'a, b\r\n<pre class="code-wrapper language-c"><code>if (a == 1)\r\n{\r\nx = 1;\r\n</code></pre>\r\n<iframe src="https://www.youtube.com/embed/x" referrerpolicy="strict-origin-when-cross-origin"></iframe>\nend' and once["changed"]
    fixed = from_dict(spark, {"a.html": once["html"]})
    assert not repair.repaired(fixed).first()["changed"]
    assert findings(fixed, only=["em-dash", "code-style", "youtube-referrer", "reveal-script-retired"]).isEmpty()
    with pytest.raises(repair.DirtyTree):
        repair.precondition(True)
    repair.precondition(True, force=True)
    s = from_dict(spark, {"a.html": '<a href="b.html"><a href="C.html"><a href="TODO-x.html"><a href="d.html">', "b.html": "", "c.html": "", "d.html": "", "TODO-x.html": ""}, untracked=("b.html", "c.html", "TODO-x.html"))
    assert rows(repair.to_stage(s)) == [("b.html",)]


def test_answers(spark):
    text = "intro\n## Vraag 1\nhello\n\n```\n## Vraag 9\n```\n## kader: X\n a: 1 | 2\n"
    blocks = answers.answer_blocks(spark.createDataFrame([("f", text)], "path string, text string"))
    assert rows(blocks.where("kind is not null").select("kind", "name", "body")) == [("kader", "X", "a: 1 | 2"), ("vraag", "1", "hello\n\n```\n## Vraag 9\n```")]
    wanted = spark.createDataFrame([("vraag", "1"), ("vraag", "2")], "kind string, name string")
    got = answers.match_answers(wanted, blocks.where("kind is not null"), ["kind", "name"])
    assert rows(got.select("kind", "name", F.coalesce("problem", F.lit("")))) == [("kader", "X", "answers nothing"), ("vraag", "1", ""), ("vraag", "2", "no answer")]
    table = spark.createDataFrame([(1, "a", 2), (2, "a", 2), (3, "b", 3)], "row int, label string, n_cells int").withColumn("k", F.lit(1))
    lines = spark.createDataFrame([(1, "a: 1|2"), (2, "a: 01"), (3, "c: x|y"), (4, "b: 1|2")], "pos int, line string").withColumn("k", F.lit(1))
    got = answers.filled_rows(table, lines, ["k"])
    assert rows(got.select("label", F.coalesce("row", F.lit(0)), F.coalesce("problem", F.lit("")))) == [("a", 1, ""), ("a", 2, ""), ("b", 3, "another number of values"), ("c", 0, "a line for no row")]
    parts = answers.answer_parts(spark.createDataFrame([(1, "p one\np two\n\n```\ncode\n```\n![a.pdf]{page=2 width=5}\n![x")], "k int, body string"), ["k"])
    assert [(r["kind"], r["text"]) for r in parts.orderBy("ord").collect()] == [("paragraph", "p one\np two"), ("fence", "code"), ("figure", "![a.pdf]{page=2 width=5}"), ("error", "![x")]
    old = "# T\n## S01\nold\nVoor de lector: n\n## S02 \nkeep  \n## S03\nold   text\n## S04\ngo\n## note\n"
    f = spark.createDataFrame([("f", old)], "path string, text string")
    got = answers.written_back(f, spark.createDataFrame([("S01", "new\r\nline"), ("S03", " old text"), ("S04", ""), ("S99", "no")], "code string, proposal string")).first()
    assert got["text"] == "# T\n## S01\n\nnew\nline\n\nVoor de lector: n\n\n## S02 \nkeep  \n## S03\nold   text\n## S04\n\nVoor de lector: De lector stuurde niets.\n\n" and got["changed"] == ["S01", "S04"]
    again = answers.written_back(f.withColumn("text", F.lit(got["text"])), spark.createDataFrame([("S04", None)], "code string, proposal string")).first()
    assert again["text"] == got["text"] and again["changed"] == []
    assert rows(answers.proposals(f).select("code", "proposal", "note")) == [("S01", "old", "n"), ("S02", "keep", ""), ("S03", "old   text", ""), ("S04", "go\n## note", "")]


def test_assembly(spark):
    q = '<h1>T</h1><h2>A</h2><h3>B</h3><ol class="vragen"><li>Q1<ul><li>a</li><li class="juist">b</li></ul></li></ol><h2>C</h2><ol class="vragen" start="2"><li>open<div class="oplossing">x</div></li><li>bad<ul><li>z</li></ul></li></ol>'
    pages = spark.createDataFrame([("p.html", q)], "path string, html string")
    got = assemble.question_rows(pages)
    assert rows(got.select("nr", "stem", "status", F.coalesce("answer", F.lit("")))) == [(1, "Q1", "ok", ""), (2, "open", "open", "x"), (3, "bad", "error: correct choices", "")]
    assert rows(assemble.question_groups(pages).select("nr", "outer_heading", F.coalesce("inner_heading", F.lit("")))) == [(1, "A", "B"), (2, "C", ""), (3, "C", "")]
    item = assemble.items(got, "pk").first()
    assert item["item_id"] == "pk-01" and "<value>b</value>" in item["xml"] and item["external_id"] == f"p.html#1@{item['hash']}"
    assert "pk-01.xml" in assemble.item_manifest(assemble.items(got, "pk"), "pk").first()["xml"]
    items = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 1, "b"), (1, 2, 1, "c"), (1, 3, 0, "d")], "k int, ord int, level int, text string")
    assert assemble.nested_list(items, ["k"]).first()["html"] == "<ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul>"
    figs = spark.createDataFrame([(1, 0, 5.0, 0.0, 2.0), (1, 1, 1.0, 1.0, 2.0), (2, 0, 5.0, 9.0, 2.0), (2, 1, 1.0, 1.0, 2.0)], "k int, ord int, x double, y double, height double")
    assert rows(assemble.reading_order(figs, ["k"]).select("k", "ord", "place")) == [(1, 0, 2), (1, 1, 1), (2, 0, 2), (2, 1, 1)]
    frag = assemble.page_transform(spark.createDataFrame([("a.html", '<body><script>x</script><iframe src="https://youtube.com/embed/x"></iframe><p id="q">t</p></body>')], "path string, html string")).first()["fragment"]
    assert frag == '<div class="pdf-note"><strong>Interactive part.</strong> It works in a browser only; open the page online.</div><div class="pdf-note"><strong>Video.</strong><br><a href="https://www.youtube.com/watch?v=x">https://www.youtube.com/watch?v=x</a></div><p id="a-html-q">t</p>'
    links = spark.createDataFrame([("a.html", '<a href="B.html"><a href="c.pdf"><a href="no.html"><a href="https://x">')], "path string, html string")
    out = assemble.page_links(links, spark.createDataFrame([("b.html",)], "path string"), spark.createDataFrame([("c.pdf",)], "path string"))
    assert rows(out.select("href", "outcome")) == [("B.html", "anchor"), ("c.pdf", "file"), ("https://x", "outside"), ("no.html", "unresolved")]
    ans = spark.createDataFrame([(1, 1, 1, "x"), (1, 1, 2, "y"), (2, 1, 1, "x"), (2, 1, 2, None)], "ch int, place int, nr int, answer string")
    assert [r["ch"] for r in assemble.chapters_with_answers(ans, ["ch"]).collect()] == [1]


def test_menu_tree(spark):
    doc = '{"modules": [{"id": "m", "title": "1. M", "name": "Em", "hidden": true, "items": [{"id": "s", "title": "S", "items": [{"id": "t", "title": "T", "page": "a.html", "instructions": "b.html"}]}]}, {"id": "m"}]}'
    flat = menu.flatten(spark.createDataFrame([("x", doc), ("y", "{")], "path string, doc string")).persist()
    got = menu.rows(flat).where("target is not null").select("kind", "target", menu.category_path(), "name", "hidden")
    assert rows(got) == [("instructions", "b.html", "1. M > S", "Em", True), ("page", "a.html", "1. M > S", "Em", True)]
    assert [r["value"] for r in menu.repeated_ids(flat).where("repeat").collect()] == ["m"] and flat.where("error is not null").count() == 1


def test_rewrites(spark):
    pages = spark.createDataFrame([("p", '<a href="x">x</a><img src="y"><a href="x">')], "path string, html string")
    assert rewrite.rewrite_references(pages, spark.createDataFrame([("p", "x", "Z")], "path string, ref string, new string")).first()["html"] == '<a href="Z">x</a><img src="y"><a href="Z">'
    cut = "<p>q</p><pre>\n <code class='a'> <code>a</code>\n<code></code><code>b &lt; c</code></code>\n</pre> t"
    two = "<pre><code>x</code></pre>\n<pre><code>y</code></pre>"
    many = "<pre><code>" + "<code>x</code>" * 30_000 + "</code></pre>"
    df = spark.createDataFrame([(1, cut), (2, two), (3, "z"), (4, cut + two + cut), (5, None), (6, many)], "id int, c string")
    done = "<p>q</p><pre>a\n\nb &lt; c</pre> t"
    assert rows(rewrite.code_block_repairs(df, "id", "c")) == [(1, done), (4, done + two + done), (6, "<pre>" + "\n".join("x" * 30_000) + "</pre>")]
    log = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, b string")
    assert rows(rewrite.replace_section(log, spark.createDataFrame([("b", "3")], "k string, b string"), "k", "b")) == [("a", "1"), ("b", "3")]


def test_slide_sections_keep_plain_shapes(spark):
    shapes = spark.createDataFrame([("p", 0, 1, "Title Slide", "title", "ctrTitle", "T"), ("p", 1, 1, "Title Slide", "text", None, "a<b"), ("p", 2, 1, "Title Slide", "text", "sldNum", "1"), ("p", 3, 2, "Content", "note", None, "n")], "path string, ord int, slide int, layout string, kind string, placeholder string, text string").withColumn("image", F.lit(None).cast("string"))
    got = {r["slide"]: r["html"] for r in assemble.slide_html(shapes).collect()}
    assert got == {1: '<section class="slide title"><h2>T</h2><p>a&lt;b</p></section>', 2: '<section class="slide content"><aside class="notes">n</aside></section>'}


def test_column_widths_round_as_in_sql(spark):
    """Every width up to 20,000 twips, among them halves of a tenth such as 6120 (107.95 mm)."""
    import duckdb

    got = spark.range(20_001).select("id", assemble.column_widths(F.array(F.col("id").cast("string")))[0])
    assert rows(got) == duckdb.sql("SELECT w, round(w / 1440.0::DOUBLE * 25.4::DOUBLE, 1) FROM range(20001) t(w) ORDER BY w").fetchall()
    assert rows(got.where("id = 6120")) == [(6120, 108.0)]


def test_staged_names_are_those_written_out(spark):
    """Names of every kind, also of none, against the plain rule; chains of chains, copies, a missing content."""
    from vellum.functions.kernels import collision_names

    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), i, rng.choice(["x.png", "X.PNG", "x-2.png", "x-2-3.png", "y", ".x", "x-2-2.png", "long" * 30 + ".txt"]), rng.choice([None, f"c{i}", "same", f"d{i}"])) for i in range(300)]
    df = spark.createDataFrame(data, "kind string, ord int, wanted string, content string").repartition(3)
    got = {r["ord"]: (r["name"], r["reused"]) for r in privacy.stage_assets(df, "kind", "content", "wanted", ["ord"]).collect()}
    want = {}
    for kind in ("a", "b", None):
        firsts, copies = {}, []
        for _, i, wish, c in (r for r in data if r[0] == kind):
            copies.append((i, c, c in firsts))
            stem, dot, ext = wish.rpartition(".")
            firsts.setdefault(c, stem[:80] + dot + ext if stem else wish)
        names = dict(zip(firsts, collision_names(list(firsts.values())), strict=True))
        want |= {i: (names[c], again) for i, c, again in copies}
    assert got == want


def test_many_assets_of_one_name(spark):
    """30,000 contents that wish one name: written out, the names would have 2.6 GB; and a null kind is a kind."""
    df = spark.range(30_000).select(F.lit(None).cast("string").alias("kind"), "id", F.lit("x.png").alias("wanted"), F.col("id").cast("string").alias("content"))
    got = privacy.stage_assets(df, "kind", "content", "wanted", ["id"]).where("name_no = id + 1 and not reused")
    assert got.select("id").count() == 30_000 and [len(r["name"]) for r in got.where("id in (0, 2)").select("name").collect()] == [5, 9]
