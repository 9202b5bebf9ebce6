"""Files written by executors in two steps: staged by tasks, then published from the committed manifest.

A task stages its files and a manifest of them below a name of its own attempt.  Only
the manifests that the job's commit names count, so a task that runs twice, or dies
halfway, leaves nothing that is ever published; an aborted job publishes nothing.
Publishing moves the staged contents to their places, spread over the tasks: a file that
already has its content is left alone, so publishing again after a failure ends in the
same state.

Paths stay below the root; one that leads out of it is an error before anything is written.
Rows of equal paths must be equal: the second of two different contents fails the task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from vellum.sources.shared import filesystem, read_bytes, write_bytes

STAGED = ".staged"


def place(path: str) -> str:
    """A path below the root, or an error."""
    parts = path.split("/")
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in parts) or parts[0] == STAGED:
        raise ValueError(f"not a path below the root: {path!r}")
    return path


@dataclass
class Staged(WriterCommitMessage):
    manifest: str
    files: int


class StagingWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.root, self.job = options["path"], options["job"]
        self.at = columns.index("path"), columns.index("content")

    def write(self, rows: Iterator) -> Staged:
        system, root = filesystem(self.root)
        attempt, entries = uuid.uuid4().hex, {}
        for row in rows:
            path, content = place(row[self.at[0]]), row[self.at[1]]
            data = content.encode() if isinstance(content, str) else bytes(content or b"")
            digest = hashlib.sha256(data).hexdigest()
            if entries.setdefault(path, {}).get("sha256", digest) != digest:
                raise ValueError(f"two contents for {path}")
            staged = f"{STAGED}/{self.job}/{attempt}/{len(entries)}"
            entries[path] = {"path": path, "staged": staged, "sha256": digest, "bytes": len(data)}
            write_bytes(system, f"{root}/{staged}", data)
        manifest = f"{attempt}.jsonl"
        write_bytes(system, f"{root}/{STAGED}/{self.job}/{manifest}", "".join(json.dumps(e) + "\n" for e in entries.values()).encode())
        return Staged(manifest, len(entries))

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = filesystem(self.root)
        done = {"manifests": [m.manifest for m in messages if m], "files": sum(m.files for m in messages if m)}
        write_bytes(system, f"{root}/{STAGED}/{self.job}/_committed", json.dumps(done).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = filesystem(self.root)
        for m in messages:
            if m:
                for path in (f"{root}/{STAGED}/{self.job}/{m.manifest.removesuffix('.jsonl')}",):
                    system.delete_dir(path)
                system.delete_file(f"{root}/{STAGED}/{self.job}/{m.manifest}")


class StagedFiles(DataSource):
    """df(path, content).write.format("staged_files").option("job", ...).mode("append").save(root)."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> StagingWriter:
        return StagingWriter(self.options, schema.names)


def stage(files: DataFrame, root: str, job: str | None = None) -> str:
    """Stage files(path, content) below root; gives the job's name."""
    job = job or uuid.uuid4().hex
    files.sparkSession.dataSource.register(StagedFiles)
    files.select("path", "content").write.format("staged_files").option("job", job).mode("append").save(root)
    return job


def committed(spark: SparkSession, root: str, job: str) -> DataFrame:
    """path, staged, sha256, bytes of what a job committed; an error if it did not commit."""
    system, base = filesystem(root)
    done = read_bytes(system, f"{base}/{STAGED}/{job}/_committed")
    if done is None:
        raise RuntimeError(f"job {job} has not committed")
    names = [f"{root}/{STAGED}/{job}/{m}" for m in json.loads(done)["manifests"]]
    schema = "path string, staged string, sha256 string, bytes long"
    return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)


def refuse_existing(spark: SparkSession, root: str, job: str, shown: int = 5) -> None:
    """An error that names some of them if files of a committed job are in place already."""

    def there(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = filesystem(root)
        for batch in batches:
            yield batch[["path"]][[system.get_file_info(f"{base}/{p}").type.name == "File" for p in batch["path"]]]

    found = [r["path"] for r in committed(spark, root, job).mapInPandas(there, "path string").limit(shown).collect()]
    if found:
        raise FileExistsError(f"there already: {', '.join(sorted(found))}")


def publish(spark: SparkSession, root: str, job: str) -> DataFrame:
    """path, bytes, state (written or unchanged) of a committed job, whose files are now in place."""

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = filesystem(root)
        for batch in batches:
            states = []
            for path, staged, digest in zip(batch["path"], batch["staged"], batch["sha256"], strict=True):
                now = read_bytes(system, f"{base}/{path}")
                if now is not None and hashlib.sha256(now).hexdigest() == digest:
                    states.append("unchanged")
                    continue
                system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                system.move(f"{base}/{staged}", f"{base}/{path}")  # one step, where the store has it
                states.append("written")
            yield batch[["path", "bytes"]].assign(state=states)

    out = committed(spark, root, job).mapInPandas(move, "path string, bytes long, state string")
    rows = new_log(root, job)
    out.write.mode("overwrite").json(rows)
    return spark.read.schema(out.schema).json(rows)


def new_log(root: str, job: str) -> str:
    """Where a job's outcomes are kept."""
    return f"{root}/{STAGED}/{job}/published"


def write_files(files: DataFrame, root: str, job: str | None = None) -> DataFrame:
    """Stage, commit and publish files(path, content); gives path, bytes and state of each."""
    return publish(files.sparkSession, root, stage(files, root, job))


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write a table so that the partitions that rows has are replaced and all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
