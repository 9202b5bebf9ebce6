"""The latest row of each key, kept on disk by a stream: a batch rewrites what it touches, and no more.

Keys are hashed into buckets.  A batch reads and rewrites only the buckets that hold its
keys, as a new version of each; a small manifest names the version of every bucket that
counts, and is replaced in one step.  What a batch writes follows the batch, not the
snapshot.  A batch that is run again finds its number in the manifest and does nothing; one
that died before its manifest leaves files that nothing names.  Old versions go after
`keep` further batches, so that readers of the last ones are not disturbed.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.shared import filesystem, read_bytes, write_bytes
from vellum.streaming.incremental import merge_latest

BUCKET = "_bucket"


class Snapshot:
    """path: a URI that driver and executors share; keys and order: columns; deleted: a boolean column, rows with it take their key away.

    buckets bounds the manifest and the number of files; it is fixed once the snapshot
    exists.  Choose it so that a bucket fits a task: the rows expected over some millions.
    """

    def __init__(self, path: str, keys: list[str], order: list[str], buckets: int = 1024, keep: int = 2, deleted: str | None = None):
        self.path, self.keys, self.order, self.keep, self.deleted = path.rstrip("/"), keys, order, keep, deleted
        self.buckets = self.manifest().get("buckets_of", buckets)

    def manifest(self) -> dict:
        """batch, buckets_of, buckets (number to version), old (version to the batch that replaced it), schema."""
        system, base = filesystem(self.path)
        return json.loads(read_bytes(system, f"{base}/_manifest.json") or b"{}")

    def _replace_manifest(self, new: dict) -> None:
        system, base = filesystem(self.path)
        draft = f"{base}/_manifest-{uuid.uuid4().hex}"
        write_bytes(system, draft, json.dumps(new).encode())
        system.move(draft, f"{base}/_manifest.json")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _read(self, spark: SparkSession, manifest: dict, only: list[int] | None = None) -> DataFrame | None:
        names = [f"{self.path}/{v}/{BUCKET}={b}" for b, v in manifest.get("buckets", {}).items() if only is None or int(b) in only]
        return spark.read.schema(manifest["schema"]).parquet(*names) if names else None

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The latest rows; None before the first batch with rows."""
        return self._read(spark, self.manifest())

    def merge(self, batch: DataFrame, batch_id: int) -> dict:
        """Take a batch in; gives the buckets it rewrote and the old versions that went.  A foreachBatch function."""
        spark, now = batch.sparkSession, self.manifest()
        if batch_id <= now.get("batch", -1):
            return {"buckets": [], "removed": []}
        rows = self._numbered(batch).persist()
        try:
            touched = sorted(r[BUCKET] for r in rows.select(BUCKET).distinct().collect())  # at most `buckets`
            version, living = f"v{batch_id:010d}-{uuid.uuid4().hex[:8]}", dict(now.get("buckets", {}))
            schema = now.get("schema") or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
            old = dict(now.get("old", {}))
            if touched:
                before = self._read(spark, now, touched)
                before = before.select(*batch.columns) if before is not None else None
                merged = self._numbered(merge_latest(rows.drop(BUCKET), before, self.keys, self.order))
                if self.deleted:
                    merged = merged.where(~F.coalesce(F.col(self.deleted), F.lit(False)))
                merged.select(*batch.columns, BUCKET).repartition(min(len(touched), 200), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{version}")
                written = self._written(version)
                for b in map(str, touched):
                    if b in living:
                        old[f"{living[b]}/{BUCKET}={b}"] = batch_id
                    if b in written:
                        living[b] = version
                    else:
                        living.pop(b, None)  # all its keys were taken away
            gone = [v for v, at in old.items() if at <= batch_id - self.keep]
            self._replace_manifest({"batch": batch_id, "buckets_of": self.buckets, "buckets": living, "old": {v: at for v, at in old.items() if v not in gone}, "schema": schema})
            self._remove(gone)
            return {"buckets": touched, "removed": gone}
        finally:
            rows.unpersist()

    def _written(self, version: str) -> set[str]:
        system, base = filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(f"{base}/{version}", allow_not_found=True))
        return {f.base_name.partition("=")[2] for f in found if f.base_name.startswith(f"{BUCKET}=")}

    def _remove(self, gone: list[str]) -> None:
        system, base = filesystem(self.path)
        for folder in gone:
            if system.get_file_info(f"{base}/{folder}").type == fs.FileType.Directory:
                system.delete_dir(f"{base}/{folder}")

    def compact(self, spark: SparkSession) -> int:
        """Write all buckets anew as one version, and remove all that nothing names; gives the number of folders that went.

        For a snapshot that many batches have left in many versions; no batch may run beside it.
        """
        now = self.manifest()
        if not now.get("buckets"):
            return 0
        version = f"c{now['batch']:010d}-{uuid.uuid4().hex[:8]}"
        self._numbered(self._read(spark, now)).repartition(min(len(now["buckets"]), 200), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{version}")
        self._replace_manifest({**now, "buckets": dict.fromkeys(now["buckets"], version), "old": {}})
        system, base = filesystem(self.path)
        rest = [f.base_name for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory and f.base_name != version]
        self._remove(rest)
        return len(rest)
