"""Spreadsheets written and reread, and image heads from bytes."""

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.functions import images
from vellum.sources import sheets

NASTY = ["", " two  blanks ", "line\nend\r\n", "<&>\"'", "é漢😀", "\x01\x1f", "_x0041_", "=1+1", "007", "TRUE", None]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_round_trip():
    data = sheets.workbook({"A & B": [NASTY, [], ["x"]], "Two": [["y"]]}, {"A & B": sheets.Layout((10, 5.5), True, "C2")})
    got = list(sheets.cells(data))
    line = lambda t: t and t.replace("\r\n", "\n")  # noqa: E731  XML readers fold line ends
    assert got == [("A & B", 0, i, line(v)) for i, v in enumerate(NASTY) if v is not None] + [("A & B", 2, 0, "x"), ("Two", 0, 0, "y")]
    assert data == sheets.workbook({"A & B": [NASTY, [], ["x"]], "Two": [["y"]]}, {"A & B": sheets.Layout((10, 5.5), True, "C2")})
    xml = zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    assert 'xSplit="2" ySplit="1" topLeftCell="C2"' in xml and '<col min="2" max="2" width="5.5"' in xml and 's="1"' in xml
    with pytest.raises(ValueError):
        sheets.workbook({"a": [["x" * 32_768]]})


@pytest.mark.parametrize("n", [0, 25, 26, 51, 52, 701, 702, 16_383])
def test_columns(n):
    assert sheets.column_number(sheets.column_letters(n) + "7") == n


def test_a_foreign_workbook():
    """Shared strings with runs and readings, numbers, booleans, formulas, errors, cells and rows without references."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="4" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x" Type="t/worksheet" Target="/xl/w.xml"/><Relationship Id="y" Type="t/sharedStrings" Target="s.xml"/></Relationships>')
        z.writestr("xl/s.xml", f"<sst {main}><si><t>plain</t></si><si><r><t>for</t></r><r><rPr><b/></rPr><t>matted</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/w.xml", f'<worksheet {main}><sheetData><row><c t="s"><v>1</v></c><c><v>1.50</v></c></row><row r="5"><c r="C5" t="b"><v>1</v></c><c t="str"><f>A1</f><v>x_x0009_y</v></c><c t="e"><v>#N/A</v></c><c r="AA5"/></row></sheetData></worksheet>')
    assert list(sheets.cells(out.getvalue())) == [("S", 0, 0, "formatted"), ("S", 0, 1, "1.50"), ("S", 4, 2, "TRUE"), ("S", 4, 3, "x\ty"), ("S", 4, 4, "#N/A")]


def test_broken_files_are_rows(spark):
    good = sheets.workbook({"s": [["v"]]})
    files = spark.createDataFrame([(1, good), (2, b"no zip"), (3, None), (4, good[:-40])], "path int, content binary")
    got = {r["path"]: (r["value"], r["error"]) for r in sheets.sheet_cells(files).collect()}
    assert got[1] == ("v", None) and all(got[k][0] is None and "BadZipFile" in got[k][1] for k in (2, 3, 4))
    assert rows(sheets.sheet_cells(files.limit(0))) == []


def test_review(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    sheet = spark.createDataFrame([("a.xlsx", "zoë", "S02", "p2", "p2", "", ""), ("a.xlsx", "Ann", "S01", "p1", "p1", "note", "ja")], "path string, naam string, code string, voorstel string, feedback string, noot string, al_feedback string")
    about = spark.createDataFrame([(p, n, v, o) for p in ("a.xlsx", "b.xlsx") for o, (n, v) in enumerate([("orgUnitId", "5"), ("folderId", "6")])], "path string, name string, value string, ord int")
    made = sheets.review_rows(sheet, about)
    assert [r["state"] for r in sheets.write_workbooks(made, root, sheets.REVIEW_LAYOUT).collect()] == ["written"] * 2
    files = spark.read.format("binaryFile").load(f"{root}/*.xlsx").select(F.substring_index("path", "/", -1).alias("path"), "content")
    cells = sheets.sheet_cells(files)
    got = sheets.reviewed(cells)
    assert rows(got.drop("error")) == [("a.xlsx", 1, "Ann", "S01", "p1", "p1", "note", "ja"), ("a.xlsx", 2, "zoë", "S02", "p2", "p2", "", "")]
    assert rows(cells.where("path = 'b.xlsx' and sheet = 'Dropbox'").select("row", "col", "value")) == [(0, 0, "orgUnitId"), (0, 1, "5"), (1, 0, "folderId"), (1, 1, "6")]
    before = (tmp_path / "r/a.xlsx").read_bytes()
    with pytest.raises(FileExistsError, match="a.xlsx"):
        sheets.write_workbooks(made.where("path = 'a.xlsx'").limit(1), root)
    assert (tmp_path / "r/a.xlsx").read_bytes() == before
    assert [r["state"] for r in sheets.write_workbooks(made.where("path = 'a.xlsx' and row = 0"), root, again=True).collect()] == ["written"]
    bad = spark.createDataFrame([("m", sheets.workbook({"Feedback": [["Code", "Naam"], ["S01", "x"]]})), ("n", sheets.workbook({"Other": [["x"]]})), ("o", b"")], "path string, content binary")
    assert {r["path"]: r["error"][:9] for r in sheets.reviewed(sheets.sheet_cells(bad)).collect()} == {"m": "the first", "n": "the first", "o": "BadZipFil"}
    d = spark.createDataFrame([("a b", " a\n b "), ("a", "b"), ("a", " \n"), ("a", None)], "p string, f string").select(sheets.decision(F.col("p"), F.col("f")).alias("d"))
    assert [r["d"] for r in d.collect()] == ["voorstel", "aangepast", "leeg", "leeg"]


# ---------------------------------------------------------------- images


def png(w, h, per_metre=None):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    phys = chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)) if per_metre else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + phys + chunk(b"IDAT", b"x")


def jpeg(w, h, unit=1, x=72):
    app = b"\xff\xe0" + struct.pack(">H5sHBHHBB", 16, b"JFIF\0", 257, unit, x, x, 0, 0)
    quant = b"\xff\xff\xdb" + struct.pack(">H", 5) + b"abc"
    return b"\xff\xd8" + app + quant + b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\0\0\0"


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", 0) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


CASES = [
    (png(640, 480), ("png", 640, 480, None, "ok")),
    (png(640, 480, 3780), ("png", 640, 480, 96.012, "ok")),
    (png(0, 5), ("png", None, None, None, "unreadable")),
    (png(3, 4)[:20], ("png", None, None, None, "unreadable")),
    (jpeg(300, 200), ("jpeg", 300, 200, 72.0, "ok")),
    (jpeg(300, 200, 2, 100), ("jpeg", 300, 200, 254.0, "ok")),
    (jpeg(300, 200, 0, 1), ("jpeg", 300, 200, None, "ok")),
    (jpeg(300, 200)[:30], ("jpeg", None, None, None, "unreadable")),
    (b"GIF89a" + struct.pack("<HH", 7, 9), ("gif", 7, 9, None, "ok")),
    (b"GIF87a\x01", ("gif", None, None, None, "unreadable")),
    (webp(b"VP8X", b"\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")), ("webp", 100, 50, None, "ok")),
    (webp(b"VP8L", b"\x2f" + (99 | 49 << 14).to_bytes(4, "little")), ("webp", 100, 50, None, "ok")),
    (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 100, 50)), ("webp", 100, 50, None, "ok")),
    (webp(b"ALPH", b"0000000000"), ("webp", None, None, None, "unreadable")),
    (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 30, -20) + b"\0" * 12 + struct.pack("<i", 3780), ("bmp", 30, 20, 96.012, "ok")),
    (b'<?xml version="1.0"?><svg viewBox="0 0 24.4 12" width="2in">', ("svg", 192, 12, 96.0, "ok")),
    (b"<svg>", ("svg", None, None, None, "unreadable")),
    (b"RIFF0000AVI ", (None, None, None, None, "unknown")),
    (b"plain", (None, None, None, None, "unknown")),
    (b"", (None, None, None, None, "unknown")),
    (None, (None, None, None, None, "unknown")),
]


def test_image_heads(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(CASES)], "i int, b binary").repartition(3)
    got = {r["i"]: tuple(r["x"]) for r in df.select("i", images.image_info_udf("b").alias("x")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(CASES)}


def test_figures_and_backgrounds(spark):
    df = spark.createDataFrame([(96, None, 0, 0), (9600, None, -1, None), (9600, 192, 18_000, -18_000), (None, None, 18_001, 0), (10, None, None, 0)], "w int, want int, x long, y long")
    got = df.select(images.figure_cm(F.col("w"), F.col("want")).alias("cm"), images.is_background(F.col("x"), F.col("y")).alias("b"), images.cropped(F.col("w"), F.array(F.lit(0.25), F.lit(0.0), F.lit(0.25), F.lit(0.0))).alias("c")).collect()
    assert [(round(r["cm"], 4), r["b"], r["c"]) for r in got] == [(2.54, True, 48), (15.0, True, 4800), (5.08, True, 4800), (15.0, False, 1), (0.2646, False, 5)]
