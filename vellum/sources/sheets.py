"""Spreadsheets (xlsx) as rows of cells, and written from them; the archive and its XML are read as streams.

A file is a bounded thing (a sheet ends at row 1,048,576), so one task reads or writes
one file; files are spread over the tasks.  Values are texts, as shown without a number
format: numbers as they stand in the file, booleans as TRUE and FALSE.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.sources import filesink
from vellum.sources.office import R, relations

S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
CELL = "sheet string, row int, col int, value string, error string"
MOST_ROWS, MOST_TEXT = 1_048_576, 32_767  #: of a sheet and of a cell (fixed values of the format)
#: Characters that XML cannot hold, and what an escape of them looks like in a sheet (fixed shape of the format).
UNSAFE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_x[0-9A-Fa-f]{4}_")
ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def column_number(ref: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in ref:
        if not "A" <= c <= "Z":
            break
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    while n >= 0:
        n, r = divmod(n, 26)
        out, n = chr(65 + r) + out, n - 1
    return out


def _text(e: ET.Element) -> str:
    """The text of a string item, its formatted runs joined, readings left out."""
    parts = [t.text or "" for t in e.findall(f"{S}t")] + [t.text or "" for r in e.findall(f"{S}r") for t in r.findall(f"{S}t")]
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def _strings(z: zipfile.ZipFile, part: str) -> list[str]:
    out: list[str] = []
    with z.open(part) as f:
        for _, e in ET.iterparse(f):
            if e.tag == f"{S}si":
                out.append(_text(e))
                e.clear()
    return out


def cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of all cells that have one, sheet by sheet; a sheet is parsed row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = next(t for kind, t in relations(z, "").values() if kind == "officeDocument") if "_rels/.rels" in z.namelist() else "xl/workbook.xml"
        rels = relations(z, root)
        shared = next((t for kind, t in rels.values() if kind == "sharedStrings"), None)
        strings = _strings(z, shared) if shared and shared in z.namelist() else []
        for sheet in ET.fromstring(z.read(root)).iter(f"{S}sheet"):
            part, row = rels[sheet.get(f"{R}id", "")][1], -1
            with z.open(part) as f:
                for _, e in ET.iterparse(f):
                    if e.tag != f"{S}row":
                        continue
                    row, col = int(e.get("r", row + 2)) - 1, -1
                    for c in e.findall(f"{S}c"):
                        col = column_number(c.get("r", "")) if c.get("r") else col + 1
                        kind, v = c.get("t", "n"), c.find(f"{S}v")
                        if kind == "inlineStr":
                            inline = c.find(f"{S}is")
                            value = _text(inline) if inline is not None else None
                        elif v is None or v.text is None:
                            value = None
                        elif kind == "s":
                            value = strings[int(v.text)]
                        else:
                            value = {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else ESCAPED.sub(lambda m: chr(int(m[1], 16)), v.text) if kind == "str" else v.text
                        if value is not None:
                            yield sheet.get("name", ""), row, col, value
                    e.clear()


def sheet_cells(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, sheet, row, col, value of the cells of files(key, content); a broken file is one row with its error."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "sheet", "row", "col", "value", "error"]
        types = [None, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

        def made(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t or key_type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    for cell in cells(data or b""):
                        rows.append((name, *cell, None))
                        if len(rows) >= 20_000:
                            yield made(rows, batch.schema[0].type)
                            rows = []
                except (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, ValueError, StopIteration) as e:
                    rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
                if rows:
                    yield made(rows, batch.schema[0].type)

    return files.select(key, content).mapInArrow(run, f"{key} {kind}, {CELL}")


@dataclass(frozen=True)
class Layout:
    """How a sheet looks: widths by column, a bold first row, and where scrolling begins."""

    widths: tuple[float, ...] = ()
    bold_first_row: bool = False
    frozen: str | None = None  #: the first cell that scrolls, such as C2


def _safe(text: str) -> str:
    """Text as XML in a sheet: what XML cannot hold, and what reads as an escape, is escaped."""
    return escape(UNSAFE.sub(lambda m: f"_x{ord(m[0][0]):04X}_" + m[0][1:], text))


def _sheet_xml(rows: list[list[str | None]], layout: Layout) -> str:
    if len(rows) > MOST_ROWS:
        raise ValueError(f"{len(rows)} rows: a sheet has {MOST_ROWS} at most")
    out = ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">']
    if layout.frozen:
        col, row = column_number(layout.frozen), int(re.sub(r"\D", "", layout.frozen)) - 1
        split = "".join(f' {a}="{n}"' for a, n in (("xSplit", col), ("ySplit", row)) if n)
        out.append(f'<sheetViews><sheetView workbookViewId="0"><pane{split} topLeftCell="{layout.frozen}" activePane="{"bottomRight" if col and row else "topRight" if col else "bottomLeft"}" state="frozen"/></sheetView></sheetViews>')
    if layout.widths:
        out.append("<cols>" + "".join(f'<col min="{i}" max="{i}" width="{w:g}" customWidth="1"/>' for i, w in enumerate(layout.widths, 1)) + "</cols>")
    out.append("<sheetData>")
    for i, row in enumerate(rows, 1):
        style = 1 if layout.bold_first_row and i == 1 else 2
        out.append(f'<row r="{i}">')
        for j, value in enumerate(row):
            if value is not None:
                if len(value) > MOST_TEXT:
                    raise ValueError(f"a cell of {len(value)} characters: {MOST_TEXT} at most")
                out.append(f'<c r="{column_letters(j)}{i}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{_safe(value)}</t></is></c>')
        out.append("</row>")
    out.append("</sheetData></worksheet>")
    return "".join(out)


TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
STYLES = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf></cellXfs></styleSheet>'


def workbook(sheets: dict[str, list[list[str | None]]], layouts: dict[str, Layout] | None = None) -> bytes:
    """An xlsx file; equal sheets give equal bytes."""
    part = lambda i: f"worksheets/sheet{i}.xml"
    ids = list(enumerate(sheets, 1))
    rel = lambda i, kind, target: f'<Relationship Id="rId{i}" Type="{OFFICE}/{kind}" Target="{target}"/>'
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    rels = f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">%s</Relationships>'
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{KIND}.styles+xml"/>' + "".join(f'<Override PartName="/xl/{part(i)}" ContentType="{KIND}.worksheet+xml"/>' for i, _ in ids) + "</Types>",
        "_rels/.rels": rels % rel(1, "officeDocument", "xl/workbook.xml"),
        "xl/workbook.xml": f'{head}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in ids) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": rels % ("".join(rel(i, "worksheet", part(i)) for i, _ in ids) + rel(len(ids) + 1, "styles", "styles.xml")),
        "xl/styles.xml": STYLES,
    } | {posixpath.join("xl", part(i)): _sheet_xml(sheets[n], (layouts or {}).get(n, Layout())) for i, n in ids}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def workbooks(rows: DataFrame, layouts: dict[str, Layout] | None = None) -> DataFrame:
    """path, content of a file for each path of rows(path, sheet_no, sheet, row, values): its sheets in number order, their rows in order."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        sheets: dict[str, list] = {}
        for r in pdf.sort_values(["sheet_no", "row"], kind="stable").itertuples():
            sheets.setdefault(r.sheet, []).append(list(r.values_))
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [workbook(sheets, layouts)]})

    cols = rows.select("path", F.col("sheet_no").cast("int").alias("sheet_no"), "sheet", F.col("row").cast("int").alias("row"), F.col("values").alias("values_"))
    return cols.groupBy("path").applyInPandas(make, "path string, content binary")


# ---------------------------------------------------------------- the review of proposals

#: Columns of a review sheet and their widths (fixed values).
REVIEW = ("Naam", "Code", "Voorstel", "Feedback", "Voor de lector", "Al feedback")
REVIEW_WIDTHS = (28, 7, 70, 70, 40, 12)
REVIEW_LAYOUT = {"Feedback": Layout(REVIEW_WIDTHS, True, "C2")}


def review_rows(sheet: DataFrame, about: DataFrame, key: str = "path") -> DataFrame:
    """Rows for `workbooks`: sheet(key, naam, code, voorstel, feedback, noot, al_feedback) by name in any case, and what it is about(key, name, value, ord).

    A path without any proposal has a sheet with its first row only.
    """
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.lower("naam"), "code"))
    columns = ("naam", "code", "voorstel", "feedback", "noot", "al_feedback")
    body = sheet.select(F.col(key).cast("string").alias("path"), F.lit(0).alias("sheet_no"), F.lit("Feedback").alias("sheet"), nth.alias("row"), F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("values"))
    heads = about.select(F.col(key).cast("string").alias("path")).distinct().select("path", F.lit(0).alias("sheet_no"), F.lit("Feedback").alias("sheet"), F.lit(0).alias("row"), F.array(*map(F.lit, REVIEW)).alias("values"))
    info = about.select(F.col(key).cast("string").alias("path"), F.lit(1).alias("sheet_no"), F.lit("Dropbox").alias("sheet"), F.col("ord").cast("int").alias("row"), F.array("name", F.col("value").cast("string")).alias("values"))
    return heads.unionByName(body).unionByName(info)


def reviewed(cells_: DataFrame, key: str = "path") -> DataFrame:
    """key, row, naam, code, voorstel, feedback, noot, al_feedback, error of review sheets read back; rows without a code are left out.

    A sheet whose first row is not that of a review, and a file that cannot be read, are a row with an error.
    """
    columns = ("naam", "code", "voorstel", "feedback", "noot", "al_feedback")
    at = lambda i: F.max(F.when(F.col("col") == i, F.col("value")))
    rows = cells_.where("error is null and sheet = 'Feedback'").groupBy(key, "row").agg(*(at(i).alias(c) for i, c in enumerate(columns)))
    moved = ~F.array(*(F.coalesce(c, F.lit("")) for c in columns)).eqNullSafe(F.array(*map(F.lit, REVIEW)))
    files = cells_.groupBy(key).agg(F.max("error").alias("e"))
    heads = files.join(rows.where("row = 0").select(key, moved.alias("moved")), key, "left")
    bad = heads.select(key, F.coalesce("e", F.when(F.coalesce("moved", F.lit(True)), "the first row is not that of a review")).alias("error")).where("error is not null")
    good = rows.where("row > 0 and code is not null and code <> ''").join(bad.select(key), key, "left_anti")
    return good.select(key, "row", *columns, F.lit(None).cast("string").alias("error")).unionByName(bad, allowMissingColumns=True)


def decision(proposal: Column, feedback: Column) -> Column:
    """leeg (nothing is sent), voorstel (as proposed but for white space) or aangepast."""
    folded = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(folded(feedback) == "", "leeg").when(folded(feedback) == folded(proposal), "voorstel").otherwise("aangepast")


def write_workbooks(rows: DataFrame, root: str, layouts: dict[str, Layout] | None = None, again: bool = False) -> DataFrame:
    """Write workbooks below root; a file that is there already may hold someone's changes, so it is an error unless `again`, and then nothing is written."""
    job = filesink.stage(workbooks(rows, layouts), root)
    if not again:
        filesink.refuse_existing(rows.sparkSession, root, job)
    return filesink.publish(rows.sparkSession, root, job)
