"""Sizes and densities of images from the first bytes of their files; no pixel is decoded."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.kernels import lazy_udf

INFO = "struct<format:string,width:int,height:int,dpi:double,status:string>"
MM_PER_INCH = 25.4
EMU_PER_MM = 36_000


class Broken(ValueError):
    """A file that begins like an image and then is none."""


def _png(b: bytes) -> tuple[int, int, float | None]:
    if b[12:16] != b"IHDR":
        raise Broken
    width, height = struct.unpack(">II", b[16:24])
    at, dpi = 8, None
    while at + 8 <= len(b):  # chunks up to the pixels
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        if kind == b"IDAT":
            break
        if kind == b"pHYs" and size == 9 and at + 17 <= len(b):
            x, _, unit = struct.unpack(">IIB", b[at + 8 : at + 17])
            dpi = x * MM_PER_INCH / 1000 if unit == 1 else None
        at += 12 + size
    return width, height, dpi


def _jpeg(b: bytes) -> tuple[int, int, float | None]:
    at, dpi = 2, None
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            raise Broken
        kind = b[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD7:  # fill bytes, and markers without content
            at += 1 if kind == 0xFF else 2
            continue
        size = struct.unpack(">H", b[at + 2 : at + 4])[0]
        if kind == 0xE0 and b[at + 4 : at + 9] == b"JFIF\0" and at + 14 <= len(b):
            unit, x = b[at + 11], struct.unpack(">H", b[at + 12 : at + 14])[0]
            dpi = float(x) if unit == 1 else x * 2.54 if unit == 2 else None
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", b[at + 5 : at + 9])
            return width, height, dpi
        if kind == 0xDA or size < 2:
            break
        at += 2 + size
    raise Broken


def _webp(b: bytes) -> tuple[int, int, float | None]:
    kind = b[12:16]
    if kind == b"VP8X":
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1, None
    if kind == b"VP8L" and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, None
    if kind == b"VP8 " and b[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", b[26:30])
        return width & 0x3FFF, height & 0x3FFF, None
    raise Broken


def _bmp(b: bytes) -> tuple[int, int, float | None]:
    if struct.unpack("<I", b[14:18])[0] == 12:
        return *struct.unpack("<HH", b[18:22]), None
    width, height = struct.unpack("<ii", b[18:26])
    per_metre = struct.unpack("<i", b[38:42])[0]
    return width, abs(height), per_metre * MM_PER_INCH / 1000 or None


#: A file's first bytes, its format and what reads its head.
KINDS = (
    (b"\x89PNG\r\n\x1a\n", "png", _png),
    (b"\xff\xd8\xff", "jpeg", _jpeg),
    (b"GIF87a", "gif", lambda b: (*struct.unpack("<HH", b[6:10]), None)),
    (b"GIF89a", "gif", lambda b: (*struct.unpack("<HH", b[6:10]), None)),
    (b"RIFF", "webp", _webp),
    (b"BM", "bmp", _bmp),
)
SVG = re.compile(rb"<svg\b[^>]*>", re.S)
LENGTH = re.compile(rb"\s*([0-9.]+)\s*(px|mm|cm|in|pt|)\s*$")
#: CSS pixels of a unit.
PIXELS = {b"": 1.0, b"px": 1.0, b"mm": 96 / MM_PER_INCH, b"cm": 960 / MM_PER_INCH, b"in": 96.0, b"pt": 96 / 72}


def _svg(tag: bytes) -> tuple[int, int, float | None]:
    """width and height of the outermost element, else the size of its view."""
    own = {m[1]: m[2] for m in re.finditer(rb'\b(width|height|viewBox)\s*=\s*["\']([^"\']*)["\']', tag)}
    view = own.get(b"viewBox", b"").replace(b",", b" ").split()
    out = []
    for name, i in ((b"width", 2), (b"height", 3)):
        m = LENGTH.match(own.get(name, b""))
        if m:
            out.append(float(m[1]) * PIXELS[m[2]])
        elif len(view) == 4:
            out.append(float(view[i]))
        else:
            raise Broken
    return round(out[0]), round(out[1]), 96.0


def image_info(data: bytes | None) -> dict:
    """format, width, height, dpi (null where the file tells none) and status: ok, unreadable (begins like an image) or unknown."""
    b = bytes(data or b"")
    for magic, name, read in KINDS:
        if b.startswith(magic) and (name != "webp" or b[8:12] == b"WEBP"):
            try:
                width, height, dpi = read(b)
            except (Broken, struct.error, IndexError):
                return {"format": name, "status": "unreadable"}
            ok = width > 0 and height > 0
            return {"format": name, "width": width, "height": height, "dpi": dpi or None, "status": "ok"} if ok else {"format": name, "status": "unreadable"}
    if tag := SVG.search(b[:4096]):
        try:
            width, height, dpi = _svg(tag[0])
            return {"format": "svg", "width": width, "height": height, "dpi": dpi, "status": "ok"}
        except (Broken, ValueError):
            return {"format": "svg", "status": "unreadable"}
    return {"status": "unknown"}


def _infos(data: pd.Series) -> pd.DataFrame:
    names = ["format", "width", "height", "dpi", "status"]
    rows = [image_info(x) for x in data]
    out = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)
    return out.astype({"width": "Int32", "height": "Int32", "dpi": "Float64"})


image_info_udf = lazy_udf(_infos, INFO)


def figure_cm(width: Column, wanted_px: Column | None = None, cap: float = 15.0) -> Column:
    """Width of a figure in a report: what its markup wants, else its own pixels, at 96 to the inch; at most the cap, which also holds where no size is known."""
    px = F.coalesce(wanted_px, width) if wanted_px is not None else width
    return F.least(F.coalesce(px.cast("double") / 96 * 2.54, F.lit(cap)), F.lit(cap))


def is_background(x_emu: Column, y_emu: Column, slack_mm: float = 0.5) -> Column:
    """Whether a picture lies at the slide's origin, half a millimetre aside: no figure but a background.  A picture without a place is none."""
    slack = slack_mm * EMU_PER_MM
    return x_emu.isNotNull() & (F.abs(x_emu) <= slack) & (F.abs(F.coalesce(y_emu, F.lit(0))) <= slack)


def cropped(width: Column, crop: Column) -> Column:
    """Pixels left of a width once the shares at its left and right (places 0 and 2 of l, t, r, b) are cut off; at least one."""
    left = F.lit(1.0) - F.coalesce(F.try_element_at(crop, F.lit(1)), F.lit(0.0)) - F.coalesce(F.try_element_at(crop, F.lit(3)), F.lit(0.0))
    return F.greatest(F.round(width * left), F.lit(1)).cast("int")
