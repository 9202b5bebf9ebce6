"""Files of a working copy, archives, and text decoding."""

from __future__ import annotations

import io
import subprocess
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that no archive is opened for (fixed values).
JUNK = r"(^|/)(__MACOSX/|\.DS_Store$|\._|~\$|Thumbs\.db$)"


#: Where Windows-1252 differs from ISO-8859-1: code to letter.
CP1252 = {b: c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


def git_tracked(root: str) -> list[str] | None:
    """Tracked paths of a working copy, None without version control."""
    try:
        out = subprocess.run(["git", "ls-files", "-z"], cwd=root, capture_output=True, check=True, timeout=60)
    except (OSError, subprocess.SubprocessError):
        return None
    return [p for p in out.stdout.decode("utf-8", "surrogateescape").split("\0") if p]


def git_ignored(root: str, path: str) -> bool | None:
    """Whether version control ignores a path, None if it can't tell."""
    try:
        code = subprocess.run(["git", "check-ignore", "-q", path], cwd=root, capture_output=True, timeout=60).returncode
    except (OSError, subprocess.SubprocessError):
        return None
    return {0: True, 1: False}.get(code)


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content of all files below root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def entries(content: bytes) -> Iterator[tuple[str, bytes | None]]:
    """(name, bytes) of an archive's files; null bytes for an unreadable one; nothing if it is no archive."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return
    for info in archive.infolist():
        if not info.is_dir():
            try:
                yield info.filename.replace("\\", "/"), archive.read(info)
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError):
                yield info.filename.replace("\\", "/"), None


def unzip(archives: DataFrame, key: str = "path", content: str = "content", drop_junk: bool = True) -> DataFrame:
    """key, ord, entry, bytes of every archive; entries stream, so no archive is expanded in one row."""
    kind = archives.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                for k, (name, body) in enumerate(entries(data or b"")):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([k], pa.int32()), pa.array([name]), pa.array([body], pa.binary())], names=[key, "ord", "entry", "bytes"])

    out = archives.select(key, content).mapInArrow(run, f"{key} {kind}, ord int, entry string, bytes binary")
    return out.where(~F.col("entry").rlike(JUNK)) if drop_junk else out


def expand_submissions(files: DataFrame, name: str = "name", content: str = "content", keys: tuple[str, ...] = ("student_id", "sub_date", "ord")) -> DataFrame:
    """Submitted files with archives expanded: keys, name, content; junk and temporary files left out."""
    is_zip = F.lower(name).endswith(".zip")
    plain = files.where(~is_zip & ~F.col(name).rlike(JUNK)).select(*keys, F.col(name).alias("name"), F.col(content).alias("content"))
    packed = files.where(is_zip).select(F.to_json(F.struct(*keys)).alias("k"), F.col(content).alias("content"))
    schema = files.select(*keys).schema
    opened = unzip(packed, "k").select(F.from_json("k", schema).alias("k"), F.col("entry").alias("name"), F.col("bytes").alias("content")).select("k.*", "name", "content")
    return plain.unionByName(opened.select(*keys, "name", "content"))


def decoded(content: str = "content"):
    """Text of bytes: UTF-8 (with or without mark) if valid, else Windows-1252."""
    valid = F.is_valid_utf8(F.col(content).cast("string"))
    latin = F.translate(F.decode(content, "iso-8859-1"), "".join(map(chr, CP1252)), "".join(CP1252.values()))
    text = F.when(valid, F.decode(content, "UTF-8")).otherwise(latin)
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def file_kind(name: str = "name"):
    """docx, pdf, image, code, or other; null for temporary files."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return (
        F.when(F.substring_index(name, "/", -1).startswith("~$"), None)
        .when(ext == "docx", "docx")
        .when(ext == "pdf", "pdf")
        .when(ext.isin("png", "jpg", "jpeg", "gif", "bmp", "webp"), "image")
        .when(ext.isin("ino", "c", "h", "cpp", "cs", "py", "js", "html", "css", "sql", "txt", "md", "json"), "code")
        .otherwise("other")
    )
