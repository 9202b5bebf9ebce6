"""Documents of word processors and slide decks as rows of blocks, with the standard library only."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.functions.kernels import vectorised

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"

RUN = "struct<text:string,bold:boolean,italic:boolean,link:string>"
BLOCK = f"ord int, kind string, level int, num_id int, num_format string, row int, col int, col_span int, row_span int, runs array<{RUN}>, image string, width_mm double, floating boolean, crop array<double>, all_bold boolean, header boolean"


def relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """id to (kind, target from the archive's root) of a part's relations."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels".lstrip("/")
    if path not in z.namelist():
        return {}
    out = {}
    for r in ET.fromstring(z.read(path)).iter(f"{REL}Relationship"):
        target = r.get("Target", "")
        out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target if r.get("TargetMode") == "External" else posixpath.normpath(posixpath.join(folder, target)).lstrip("/"))
    return out


def merged(runs: list[dict]) -> list[dict]:
    """Neighbours of equal format as one run."""
    out: list[dict] = []
    for r in runs:
        if out and all(out[-1][k] == r[k] for k in ("bold", "italic", "link")):
            out[-1]["text"] += r["text"]
        elif r["text"]:
            out.append(dict(r))
    return out


def _on(props, tag: str) -> bool:
    x = props.find(tag) if props is not None else None
    return x is not None and x.get(f"{W}val", "1") not in ("0", "false", "none")


def _numbering(z: zipfile.ZipFile) -> dict[int, dict[int, str]]:
    """num_id to level to format."""
    if "word/numbering.xml" not in z.namelist():
        return {}
    root = ET.fromstring(z.read("word/numbering.xml"))
    kinds = {a.get(f"{W}abstractNumId"): {int(x.get(f"{W}ilvl", 0)): (f.get(f"{W}val", "") if (f := x.find(f"{W}numFmt")) is not None else "") for x in a.iter(f"{W}lvl")} for a in root.iter(f"{W}abstractNum")}
    return {int(n.get(f"{W}numId", 0)): kinds.get(a.get(f"{W}val"), {}) for n in root.iter(f"{W}num") if (a := n.find(f"{W}abstractNumId")) is not None}


def docx_blocks(content: bytes) -> list[dict]:
    """Paragraphs, table cells and images in document order."""
    z = zipfile.ZipFile(io.BytesIO(content))
    rels, formats = relations(z, "word/document.xml"), _numbering(z)
    out: list[dict] = []
    empty = {k.split()[0]: None for k in re.sub(r"<[^>]*>+", "", BLOCK).split(", ")}

    def add(kind: str, **more) -> None:
        out.append(empty | {"ord": len(out), "kind": kind, "runs": []} | more)

    def runs_of(p) -> list[dict]:
        runs = []
        for parent in p.iter():
            link = rels.get(parent.get(f"{R}id", ""), ("", None))[1] if parent.tag == f"{W}hyperlink" else None
            if parent is not p and parent.tag not in (f"{W}hyperlink", f"{W}ins", f"{W}smartTag"):
                continue
            for r in parent.findall(f"{W}r"):
                props = r.find(f"{W}rPr")
                text = "".join(x.text or "" if x.tag == f"{W}t" else "\t" if x.tag == f"{W}tab" else "\n" if x.tag in (f"{W}br", f"{W}cr") else "" for x in r)
                runs.append({"text": text, "bold": _on(props, f"{W}b"), "italic": _on(props, f"{W}i"), "link": link})
        return merged(runs)

    def images(el) -> None:
        for drawing in el.iter(f"{W}drawing"):
            blip = next(drawing.iter(f"{A}blip"), None)
            if blip is None:
                continue
            extent, src = next(drawing.iter(f"{WP}extent"), None), next(drawing.iter(f"{A}srcRect"), None)
            crop = [int(src.get(k, 0)) / 100_000 for k in "ltrb"] if src is not None else None
            add("image", image=rels.get(blip.get(f"{R}embed", ""), ("", None))[1], width_mm=int(extent.get("cx", 0)) / 36000 if extent is not None else None, floating=drawing.find(f"{WP}anchor") is not None, crop=crop)

    def paragraph(p, **more) -> None:
        props = p.find(f"{W}pPr")
        style = (s.get(f"{W}val", "") if props is not None and (s := props.find(f"{W}pStyle")) is not None else "")
        num = props.find(f"{W}numPr") if props is not None else None
        heading = re.search(r"(?:heading|kop|titre|titel)\s*(\d)", style, re.I)
        num_id = int(x.get(f"{W}val", 0)) if num is not None and (x := num.find(f"{W}numId")) is not None else None
        level = int(x.get(f"{W}val", 0)) if num is not None and (x := num.find(f"{W}ilvl")) is not None else 0
        runs = runs_of(p)
        shown = [r for r in runs if r["text"].strip()]
        kind = "heading" if heading else "item" if num_id else "paragraph"
        add(kind, level=int(heading[1]) if heading else level if num_id else None, num_id=num_id, num_format=formats.get(num_id or 0, {}).get(level), runs=runs, all_bold=bool(shown) and all(r["bold"] for r in shown), **more)
        images(p)

    def table(t) -> None:
        grid: list[list[dict]] = []
        for tr in t.findall(f"{W}tr"):
            at, cells = 0, []
            trp = tr.find(f"{W}trPr")
            for tc in tr.findall(f"{W}tc"):
                props = tc.find(f"{W}tcPr")
                span = int(x.get(f"{W}val", 1)) if props is not None and (x := props.find(f"{W}gridSpan")) is not None else 1
                merge = props.find(f"{W}vMerge") if props is not None else None
                below = merge is not None and merge.get(f"{W}val") != "restart"
                lines = [[*runs_of(p), {"text": "\n", "bold": False, "italic": False, "link": None}] for p in tc.findall(f"{W}p")]
                runs = merged([r for line in lines for r in line][:-1])
                shown = [r for r in runs if r["text"].strip()]
                cells.append({"col": at, "span": span, "below": below, "runs": runs, "bold": bool(shown) and all(r["bold"] for r in shown), "header": trp is not None and trp.find(f"{W}tblHeader") is not None, "el": tc})
                at += span
            grid.append(cells)
        for r, cells in enumerate(grid):
            for c in cells:
                if c["below"]:
                    continue
                height = 1
                while r + height < len(grid) and any(x["below"] and x["col"] == c["col"] for x in grid[r + height]):
                    height += 1
                add("cell", row=r, col=c["col"], col_span=c["span"], row_span=height, runs=c["runs"], all_bold=c["bold"], header=c["header"])
                images(c["el"])

    body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
    for el in body if body is not None else []:
        if el.tag == f"{W}p":
            paragraph(el)
        elif el.tag == f"{W}tbl":
            add("table")
            table(el)
    return out


def pptx_blocks(content: bytes) -> list[dict]:
    """Shapes of slides in presentation order: slide, layout, kind, level, text, position and size in mm."""
    z = zipfile.ZipFile(io.BytesIO(content))
    main = relations(z, "ppt/presentation.xml")
    order = [main[x.get(f"{R}id")][1] for x in ET.fromstring(z.read("ppt/presentation.xml")).iter(f"{P}sldId") if x.get(f"{R}id") in main]
    out: list[dict] = []
    for no, part in enumerate(order, 1):
        rels = relations(z, part)
        layout_part = next((t for k, t in rels.values() if k == "slideLayout"), None)
        layout = (x.get("name") if (x := ET.fromstring(z.read(layout_part)).find(f"{P}cSld")) is not None else None) if layout_part in z.namelist() else None
        root = ET.fromstring(z.read(part))

        def add(kind: str, level=None, text=None, image=None, box=None, crop=None, placeholder=None, no=no, layout=layout, bold=None) -> None:
            x, y, w, h = box or (None,) * 4
            out.append({"ord": len(out), "slide": no, "layout": layout, "kind": kind, "placeholder": placeholder, "level": level, "text": text, "bold": bold, "image": image, "x": x, "y": y, "width": w, "height": h, "crop": crop})

        def box_of(shape):
            xf = next((e for e in shape.iter() if e.tag in (f"{A}xfrm", f"{P}xfrm")), None)
            off, ext = (xf.find(f"{A}off"), xf.find(f"{A}ext")) if xf is not None else (None, None)
            return None if off is None or ext is None else tuple(int(e.get(k, 0)) / 36000 for e, k in ((off, "x"), (off, "y"), (ext, "cx"), (ext, "cy")))

        def paragraphs(el):
            for p in el.iter(f"{A}p"):
                text = "".join("\n" if x.tag == f"{A}br" else x.findtext(f"{A}t") or "" for x in p if x.tag in (f"{A}r", f"{A}br", f"{A}fld"))
                props = p.find(f"{A}pPr")
                yield int(props.get("lvl", 0)) if props is not None else 0, text, all((rp := r.find(f"{A}rPr")) is not None and rp.get("b") == "1" for r in p.iter(f"{A}r"))

        for shape in root.iter():
            if shape.tag == f"{P}sp":
                ph = next(shape.iter(f"{P}ph"), None)
                kind = ph.get("type", "body") if ph is not None else None
                for level, text, bold in paragraphs(shape):
                    if text.strip():
                        add("title" if kind in ("title", "ctrTitle") else "text", level, text, box=box_of(shape), placeholder=kind, bold=bold)
            elif shape.tag == f"{P}pic":
                blip, src = next(shape.iter(f"{A}blip"), None), next(shape.iter(f"{A}srcRect"), None)
                add("picture", image=rels.get(blip.get(f"{R}embed", ""), ("", None))[1] if blip is not None else None, box=box_of(shape), crop=[int(src.get(k, 0)) / 100_000 for k in "ltrb"] if src is not None else None)
            elif shape.tag == f"{A}tbl":
                for r, tr in enumerate(shape.findall(f"{A}tr")):
                    add("row", level=r, text=" | ".join(" ".join(t for _, t, _ in paragraphs(tc)) for tc in tr.findall(f"{A}tc")))
        notes = next((t for k, t in rels.values() if k == "notesSlide"), None)
        if notes in z.namelist():
            for shape in ET.fromstring(z.read(notes)).iter(f"{P}sp"):
                ph = next(shape.iter(f"{P}ph"), None)
                if ph is not None and ph.get("type") == "body":
                    for level, text, bold in paragraphs(shape):
                        if text.strip():
                            add("note", level, text)
    return out


SHAPE = "ord int, slide int, layout string, kind string, placeholder string, level int, text string, bold boolean, image string, x double, y double, width double, height double, crop array<double>"


def _reader(parse, fields: str):
    from pyspark.sql.types import _parse_datatype_string

    def rows(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
        """key and the blocks of each document; error holds what a broken one fails with."""
        kind = files.schema[key].dataType.simpleString()
        schema = _parse_datatype_string(f"{key} {kind}, error string, {fields}")
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    try:
                        found = [{key: k, "error": None} | b for b in parse(data)]
                    except (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError) as e:
                        found = [{key: k, "error": f"{type(e).__name__}: {e}"}]
                    if found:
                        yield pa.RecordBatch.from_pylist([{f.name: b.get(f.name) for f in arrow} for b in found], schema=arrow)

        return files.select(key, content).mapInArrow(run, schema)

    return rows


read_docx = _reader(docx_blocks, BLOCK)
read_pptx = _reader(pptx_blocks, SHAPE)


def docx_tables(content: bytes) -> list[dict]:
    """The tables of a document in order: whether their style sets off the first row and the table asks for it, and their columns' widths in twips.

    A style that says nothing about first rows draws none, however the table's flag stands.
    """
    z = zipfile.ZipFile(io.BytesIO(content))
    backed: set[str] = set()
    if "word/styles.xml" in z.namelist():
        for style in ET.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
            if any(c.get(f"{W}type") == "firstRow" for c in style.findall(f"{W}tblStylePr")):
                backed.add(style.get(f"{W}styleId", ""))
    out = []
    for n, t in enumerate(ET.fromstring(z.read("word/document.xml")).iter(f"{W}tbl")):
        props, grid = t.find(f"{W}tblPr"), t.find(f"{W}tblGrid")
        look = props.find(f"{W}tblLook") if props is not None else None
        style = props.find(f"{W}tblStyle") if props is not None else None
        asks = look is not None and look.get(f"{W}firstRow") == "1"
        out.append({"table_no": n, "styled": asks and style is not None and style.get(f"{W}val") in backed, "twips": [c.get(f"{W}w") for c in grid.findall(f"{W}gridCol")] if grid is not None else []})
    return out


docx_tables_udf = vectorised(docx_tables, "array<struct<table_no:int,styled:boolean,twips:array<string>>>")
