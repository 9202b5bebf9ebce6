"""The folder that driver and executors share, and paths in it by way of Arrow's file systems."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; an own folder only where it is unset and all run on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vellum-{name}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


def write_bytes(system: fs.FileSystem, path: str, data: bytes) -> None:
    """A whole file; its folders are made."""
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as f:
        f.write(data)


def read_bytes(system: fs.FileSystem, path: str) -> bytes | None:
    """A whole file, None if there is none."""
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as f:
        return f.read()
