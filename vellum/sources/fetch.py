"""Remote files of an import, fetched once each by the executors and kept by their content.

Only http and https addresses are asked for.  What comes is taken by what it is, not by what
it says: an image's first bytes must be those of a type that the answer names, and its
size at most `max_bytes`, of which no more is read.  Requests to one host go out no
faster than `per_second` in each task, and `tasks` bounds how many tasks ask at once, all of
a host in one; a host with very many addresses is a long task, which its own limit makes
it anyway.  A file is kept as its SHA-256 below the cache folder, so equal contents are
stored once, and an address that the cache's index knows is not asked for again.

Everything that can go wrong is a row: status is kept, cached, or why not.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.images import image_info
from vellum.sources.shared import filesystem, read_bytes, write_bytes

#: Content types that are taken, the file's ending, and the format its bytes must show (fixed values).
TYPES = {"image/png": (".png", "png"), "image/jpeg": (".jpg", "jpeg"), "image/gif": (".gif", "gif"), "image/svg+xml": (".svg", "svg"), "image/webp": (".webp", "webp"), "image/bmp": (".bmp", "bmp")}
ROW = "url string, status string, sha256 string, bytes long, ext string"


def open_http(url: str, most: int) -> tuple[int, str, bytes]:
    """Status, content type and at most `most` bytes."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "vellum-import"}), timeout=30) as r:
            return r.status, r.headers.get("Content-Type") or "", r.read(most)
    except urllib.error.HTTPError as e:
        return e.code, "", b""


class FolderWeb:
    """Answers from files in a folder, named by the SHA-256 of the address: an import tried without a network.

    A file is a line of JSON with status and type, then the body.
    """

    def __init__(self, root: str):
        self.root = root

    @staticmethod
    def name(url: str) -> str:
        return hashlib.sha256(url.encode()).hexdigest()

    def __call__(self, url: str, most: int) -> tuple[int, str, bytes]:
        system, base = filesystem(self.root)
        data = read_bytes(system, f"{base}/{self.name(url)}")
        if data is None:
            raise urllib.error.URLError("no such host")
        head, _, body = data.partition(b"\n")
        answer = json.loads(head)
        return answer["status"], answer["type"], body[:most]


class Pace:
    """A token bucket for each host: `burst` at once, then so many a second."""

    def __init__(self, per_second: float, burst: int = 5, clock: Callable[[], float] = time.monotonic, sleep: Callable = time.sleep):
        self.per_second, self.burst, self.clock, self.sleep = per_second, burst, clock, sleep
        self.left: dict[str, tuple[float, float]] = {}

    def wait(self, host: str) -> None:
        now = self.clock()
        tokens, at = self.left.get(host, (float(self.burst), now))
        tokens = min(float(self.burst), tokens + (now - at) * self.per_second)
        if tokens < 1:
            self.sleep((1 - tokens) / self.per_second)
            now, tokens = self.clock(), 1.0
        self.left[host] = (tokens - 1, now)
        if len(self.left) > 10_000:  # hosts that are full again need no memory
            self.left = {h: (n, a) for h, (n, a) in self.left.items() if n + (now - a) * self.per_second < self.burst}


def judged(status: int, kind: str, data: bytes, max_bytes: int) -> tuple[str, str | None]:
    """(kept or why not, ending) of an answer."""
    if status != 200:
        return f"status {status}", None
    if len(data) > max_bytes:
        return "too large", None
    found = TYPES.get(kind.split(";")[0].strip().lower())
    if found is None:
        return "type not taken", None
    seen = image_info(data)
    return ("kept", found[0]) if seen["status"] == "ok" and seen["format"] == found[1] else ("not what it says", None)


def fetched(urls: DataFrame, cache: str, url: str = "url", max_bytes: int = 10 << 20, per_second: float = 2.0, burst: int = 5, tasks: int = 16, web: Callable | None = None) -> DataFrame:
    """url, status, sha256, bytes, ext of each different address; what is kept is a file named sha256 + ext below cache.

    The answers of this run are added to the cache's index, a table, when all are in.
    """
    spark = urls.sparkSession
    asked = urls.select(F.trim(F.col(url).cast("string")).alias("url")).where("url <> ''").distinct()
    index, known = f"{cache}/index", None
    system, base = filesystem(cache)
    if system.get_file_info(f"{base}/index").type.name == "Directory":
        known = spark.read.schema(ROW).parquet(index).where("status = 'kept'").groupBy("url").agg(F.max(F.struct("sha256", "bytes", "ext")).alias("k"))
    open_ = asked if known is None else asked.join(known.select("url"), "url", "left_anti")
    host = F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, pace = web or open_http, Pace(per_second, burst)
        system, base = filesystem(cache)
        for batch in batches:
            rows = []
            for address, name in zip(batch["url"], batch["host"], strict=True):
                if not address.lower().startswith(("http://", "https://")):
                    rows.append((address, "not http", None, None, None))
                    continue
                pace.wait(name)
                try:
                    status, kind, data = ask(address, max_bytes + 1)
                except (OSError, ValueError) as e:
                    rows.append((address, f"unreachable: {type(e).__name__}", None, None, None))
                    continue
                verdict, ext = judged(status, kind, data, max_bytes)
                digest = hashlib.sha256(data).hexdigest() if ext else None
                if ext:
                    place = f"{base}/{digest[:2]}/{digest}{ext}"
                    if system.get_file_info(place).type.name != "File":
                        draft = f"{place}.{uuid.uuid4().hex}"
                        write_bytes(system, draft, data)
                        system.move(draft, place)
                rows.append((address, verdict, digest, len(data) if ext else None, ext))
            yield pd.DataFrame(rows, columns=["url", "status", "sha256", "bytes", "ext"]).astype({"bytes": "Int64"})

    new = open_.withColumn("host", host).repartition(tasks, "host").mapInPandas(run, ROW)
    batch = f"{index}/run={uuid.uuid4().hex}"
    new.write.parquet(batch)  # asked once, whatever reads the result
    done = spark.read.schema(ROW).parquet(batch)
    if known is None:
        return done
    return done.unionByName(asked.join(known, "url").select("url", F.lit("cached").alias("status"), "k.sha256", "k.bytes", "k.ext"))
