"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contract: maximal runs without space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches of whole texts small, so that a worker's memory is bounded by rows * text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where it is unset and all run on one machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        sc.setCheckpointDir(base)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    _SCRATCH.append(f"{shared_dir(spark)}/vellum-{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def scratch_mark() -> int:
    """How many scratch paths there are by now."""
    return len(_SCRATCH)


def clean(spark: SparkSession, since: int = 0, but_last: bool = False) -> None:
    """Delete this session's scratch tables from the mark on, once nothing reads results that are built on them."""
    jvm = spark.sparkContext._jvm
    kept = _SCRATCH[-1:] if but_last and len(_SCRATCH) > since else []
    for path in _SCRATCH[since:]:
        if path not in kept:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _SCRATCH[since:] = kept


def drop(spark: SparkSession, path: str) -> None:
    """Delete one scratch path that nothing will read again."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _SCRATCH.remove(path)


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Within, shuffle files go when the query that wrote them ends: its result is a table, nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with brief_shuffles(spark):
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder; for small tables that are read again and again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(mod)


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
