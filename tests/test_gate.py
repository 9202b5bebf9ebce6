"""The validation gate: one pass, all errors together, nothing handed on that fails."""

import pytest
from pyspark.sql import functions as F

from vellum.plans import gate


def test_gate(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") != 50, F.lit("x")).alias("t"))
    assert gate.gated(df, {"negative": F.col("id") < 0, "null": F.col("t") == "y"}, "id").count() == 100
    with pytest.raises(gate.Invalid) as e:
        gate.gated(df, {"big": F.col("id") > 89, "never": F.col("id") < 0, "no text": F.col("t").isNull()}, F.concat(F.lit("row "), F.col("id").cast("string")), F.desc("id"), shown=3)
    assert e.value.failures == {"big": 10, "no text": 1}
    assert str(e.value) == "big: 10 (row 99, row 98, row 97, ...)\nno text: 1 (row 50)"
    assert gate.gated(df.limit(0), {"any": F.lit(True)}).count() == 0


def test_gate_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(50).mapInPandas(look, "id long")
    out = gate.gated(df, {"big": F.col("id") > 100}, "id")
    assert out.count() == 50 and out.agg(F.sum("id")).first()[0] == 1225 and seen.value == 50


def test_gate_on_doubles(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, ext string")
    with pytest.raises(gate.Invalid, match=r"double: 2 \(1, 2\)"):
        gate.gated(df, {"double": gate.unique("ext")}, "id")


def test_references_to_nothing_abort(spark):
    from vellum.operators import rewrite

    pages = spark.createDataFrame([("d/p.html", '<img src="../i.png#f"><a href="http://x"><a href="q.html?a=1">')], "path string, html string")
    files = spark.createDataFrame([("i.png",)], "path string")
    with pytest.raises(gate.Invalid, match=r"references to nothing: 1 \(d/p.html: q.html\?a=1\)"):
        rewrite.absolute_references(pages, files)
    want = '<img src="/i.png#f"><a href="http://x"><a href="/d/q.html?a=1">'
    assert rewrite.absolute_references(pages, None, root="/").first()["html"] == want
    both = files.union(spark.createDataFrame([("d/q.html",)], "path string"))
    assert rewrite.absolute_references(pages, both, root="/").first()["html"] == want


def test_lookups_and_answers_abort_together(spark):
    from vellum.operators import answers, reconcile

    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "ext string")
    have = spark.createDataFrame([("a", 1, None), ("a", 2, True), ("b", 3, False), ("b", 4, None), ("c", 5, None), ("c", 6, None)], "ext string, id int, trashed boolean")
    with pytest.raises(gate.Invalid) as e:
        reconcile.by_external_id(wanted, have, "ext", "id", "trashed")
    assert str(e.value) == "external ids of several rows: 2 (b: 2 rows, 3 to 4, c: 2 rows, 5 to 6)"
    good = reconcile.by_external_id(wanted.where("ext in ('a', 'd')"), have, "ext", "id", "trashed")
    assert sorted(tuple(r) for r in good.collect()) == [("a", 1), ("d", None)]
    matched = spark.createDataFrame([("10", "answers nothing"), ("9", "answers nothing"), ("x", "answers nothing"), ("3", "no answer"), ("4", None)], "name string, problem string")
    with pytest.raises(gate.Invalid) as e:
        answers.all_matched(matched, "name")
    assert str(e.value) == "no answer: 1 (3)\nanswers nothing: 3 (9, 10, x)"
    assert answers.all_matched(matched.where("problem is null"), "name").count() == 1


def test_sources_of_questions_abort_together(spark):
    from vellum.operators import assemble

    pages = spark.createDataFrame([("p.html", '<ol class="vragen"><li data-bron="a.html b.html">q</li><li data-bron=" c.html ">r</li></ol>'), ("q.html", "x")], "path string, html string")
    files = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    with pytest.raises(gate.Invalid) as e:
        assemble.checked_sources(pages, files("a.html"))
    assert str(e.value) == "sources that are not there: 2 (p.html question 1: b.html, p.html question 2: c.html)"
    assert assemble.checked_sources(pages, files("a.html", "b.html", "c.html")).count() == 2


def test_docx_tables(spark):
    import io
    import zipfile

    from vellum.sources import office

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    table = lambda style, flag, grid: f'<w:tbl><w:tblPr><w:tblStyle w:val="{style}"/><w:tblLook w:firstRow="{flag}"/></w:tblPr><w:tblGrid>{grid}</w:tblGrid></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="Plain"><w:tblStylePr w:type="firstRow"/></w:style><w:style w:styleId="Grid"><w:tblStylePr w:type="lastRow"/></w:style></w:styles>')
        z.writestr("word/document.xml", f'<w:document {w}><w:body>{table("Plain", 1, "<w:gridCol w:w=\'1440\'/><w:gridCol/>")}{table("Plain", 0, "")}{table("Grid", 1, "")}<w:tbl/></w:body></w:document>')
    (r,) = spark.createDataFrame([(out.getvalue(),)], "b binary").select(office.docx_tables_udf("b").alias("t")).collect()
    assert [(t["table_no"], t["styled"], t["twips"]) for t in r["t"]] == [(0, True, ["1440", None]), (1, False, []), (2, False, []), (3, False, [])]
