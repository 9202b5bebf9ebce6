"""WARC archives with payload de-duplication and a merged capture index.

Writing.  Among records with equal payloads of at least `least_bytes`, the one with
the smallest page_id is a response, the others are revisits of it.  A task appends its
records, one gzip member each, to files of at most `file_bytes` in the shared folder,
and lists them in runs sorted by (URL key, time, id).  File names are unique to the
attempt; only files that a committed index names count, so a task that is lost and
run again leaves no double records.

Index.  Runs are merged by a loser tree.  The key space is cut into ranges, so each
merging task gets a bounded slice of every run; the key ends in page_id, which lets
the captures of one URL, however many, span several ranges.  The merge numbers the
captures of its slice and of each URL within it, and names the capture before; the
slices' ends (one row for each task) turn this into the position in the global order,
the capture's number in its URL's history and the page captured before it.

Reading.  Entries of the merged index are dealt by file and read in order of offset, so
each file is read once, forward; a record carries its place in the merged order along.
Revisits take size and digest from the record they refer to.

Payloads.  Equal ones are found by id and digest alone.  Up to `broadcast_rows` repeated
digests (about 100 bytes each) are broadcast to the pages; beyond that the pages are
joined on id and digest, so that a payload with very many copies is no hot key of the
texts.

A null html is an empty payload, a null url has an empty key, a null page_id comes
before all others and in no reference; an id that is no integer counts as null.  Rows that repeat a page_id are records of their
own; they are responses if that id is the smallest of their payload.  Ties of key, time
and id keep the order of the runs.  A payload of any length is one record, held whole by
one task.  A capture time may be any 64-bit number of seconds; WARC-Date shows it within
the years 1 to 9999.  An empty table writes nothing and gives an empty result.  Only
page_id, url and html are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import scratch, small_batches, utf8, written

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "url_key string, at long, page_id long, record_type string, file string, offset long, length long, run string"
FIELDS = ["url_key", "at", "page_id", "record_type", "file", "offset", "length", "run"]


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query; without scheme, user, www, default port and fragment."""
    if not url:
        return ""
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or ""), p.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) if host else ""
    if port and (p.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){(p.path or '/').lower()}" + (f"?{p.query.lower()}" if p.query else "")


def warc_date(at: int) -> str:
    """Seconds since 1970 as a date of WARC; what lies outside the years 1 to 9999 is moved to their ends."""
    return f"{datetime(1970, 1, 1) + timedelta(seconds=min(max(at, -62_135_596_800), 253_402_300_799)):%Y-%m-%dT%H:%M:%S}Z".rjust(20, "0")


def record(page_id: int | None, url: str | None, at: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, not compressed."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {warc_date(at)}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return utf8("\r\n".join(head)) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def members(stream: io.BufferedIOBase, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of an archive, one by one."""
    left = b""
    while True:
        left = left or stream.read(step)
        if not left:
            return
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            parts.append(one.decompress(left))
            left = one.unused_data if one.eof else stream.read(step)
            if not left and not one.eof:
                raise EOFError("the archive ends within a record")
        yield b"".join(parts)


def _gzip(raw: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, the winner climbs; one path is replayed per row."""

    END = None

    def __init__(self, runs: list[Iterable], key=lambda row: row):
        self.key = key
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.head = [next(r, self.END) for r in self.runs] or [self.END]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; an ended run comes last, ties go to the earlier run."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (self.key(x), a) < (self.key(y), b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.loser[node]
            if other < 0:  # the other side of this match has not come yet
                self.loser[node] = winner
                return
            if self._less(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator:
        while (row := self.head[w := self.loser[0]]) is not self.END:
            yield row
            self.head[w] = next(self.runs[w], self.END)
            self._replay(w)


def _writer(folder: str, file_bytes: int, run_rows: int):
    """mapInArrow body: (page_id, url, at, html, digest, refers_to) to index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        rows: list[tuple] = []
        out = name = None
        size = 0

        def flush() -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[0], r[1], _id(r[2])))
            token = uuid.uuid4().hex
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array([token] * len(rows), pa.string())], names=FIELDS)
            rows.clear()
            return made

        try:
            for batch in batches:
                for page_id, url, at, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or size >= file_bytes:
                        if out:
                            out.close()
                        name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    data = _gzip(record(page_id, url, at, utf8(html), digest, refers_to))
                    out.write(data)
                    rows.append((url_key(url), at, page_id, "response" if refers_to is None else "revisit", name, size, len(data)))
                    size += len(data)
                    if len(rows) >= run_rows:
                        yield flush()
        finally:
            if out:
                out.close()
        if rows:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str, at: Column, least_bytes: int = 100, file_bytes: int = 64 << 20, run_rows: int = 100_000, broadcast_rows: int = 200_000) -> DataFrame:
    """Write pages(page_id, url, html) below folder; the index of committed records, as sorted runs.  at: capture time in epoch seconds."""
    small_batches(pages.sparkSession)
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").try_cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), at.cast("long").alias("at"), "html", F.sha2(body, 256).alias("digest"), (F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes).alias("long"))
    ids = rows.where("long").select("page_id", "digest")
    first = written(ids.groupBy("digest").agg(F.min("page_id").alias("rep"), F.count("*").alias("n")).where("n > 1 and rep is not null").select(F.col("digest").alias("d"), "rep"), "warc-repeated")
    if first.count() <= broadcast_rows:
        dealt = rows.join(F.broadcast(first), (rows["digest"] == first["d"]) & rows["long"], "left")
    else:
        known = ids.distinct().join(first, F.col("digest") == F.col("d")).select(F.col("page_id").alias("k"), "d", "rep")
        dealt = rows.join(known, rows["page_id"].eqNullSafe(known["k"]) & (rows["digest"] == known["d"]) & rows["long"], "left")
    refers = F.when(F.col("rep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("rep")), F.col("rep"))
    return written(dealt.select("page_id", "url", "at", "html", "digest", refers.alias("refers_to")).mapInArrow(_writer(folder, file_bytes, run_rows), INDEX), "warc-runs")


MERGED = INDEX + ", slice int, place long, nth long, previous long"
MERGED_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(row[7], []).append((row[0], row[1], _id(row[2]), row))
    for rows in runs.values():
        rows.sort(key=lambda r: r[:3])  # slices of a run come in order but for a reread block; linear then
    own = TaskContext.get().partitionId() if TaskContext.get() else 0
    step: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), MERGED_KINDS, strict=True)], names=[*FIELDS, "slice", "place", "nth", "previous"])

    key, nth, previous = None, 0, None
    for place, (_, _, _, row) in enumerate(LoserTree([runs[k] for k in sorted(runs)], key=lambda r: r[:3])):
        key, nth, previous = (row[0], nth + 1, previous) if row[0] == key else (row[0], 1, None)
        step.append((*row, own, place, nth, previous))
        previous = row[2]
        if len(step) == 10_000:
            yield batch_of(step)
            step = []
    if step:
        yield batch_of(step)


def _id(page_id: int | None) -> tuple:
    """Ids in order, a missing one first."""
    return (page_id is not None, page_id or 0)


def carried(ends: list) -> list[tuple]:
    """What each slice begins with, from the slices' (slice, rows, first key, last key, last nth, last page) in order.

    Gives (slice, captures before it, first key, how many of that key came before, the last of them).
    """
    out, before, key, nth, page = [], 0, None, 0, None
    for number, n, first, last, last_nth, last_page in ends:
        goes_on = first == key
        out.append((number, before, first, nth if goes_on else 0, page if goes_on else None))
        nth = last_nth + (nth if goes_on and last == first else 0)
        before, key, page = before + n, last, last_page
    return out


def merge_index(runs: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """All runs in one order by (url_key, at, page_id), with position, nth (of its URL) and previous_id (of its URL)."""
    spark = runs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // rows_per_task))
    merged = written(runs.repartitionByRange(n, "url_key", "at", "page_id").mapInArrow(_merge, MERGED), "warc-merged")
    last = F.max_by(F.struct("url_key", "nth", "page_id"), "place").alias("last")
    ends = merged.groupBy("slice").agg(F.count("*").alias("n"), F.min("url_key").alias("first"), last).orderBy("slice").collect()  # one row for each task
    starts = spark.createDataFrame(carried([(r["slice"], r["n"], r["first"], r["last"]["url_key"], r["last"]["nth"], r["last"]["page_id"]) for r in ends]), "s int, before long, s_key string, had long, s_page long")
    whole = merged.join(F.broadcast(starts), F.col("slice") == F.col("s"))
    goes_on = (F.col("url_key") == F.col("s_key")) & (F.col("had") > 0)
    return whole.select(
        *FIELDS, (F.col("before") + F.col("place")).alias("position"), (F.col("nth") + F.when(goes_on, F.col("had")).otherwise(0)).alias("nth"),
        F.when(goes_on & (F.col("nth") == 1), F.col("s_page")).otherwise(F.col("previous")).alias("previous_id"),
    )


#: What the index knows of a record, beside where it lies.
PLACED = ["position", "nth", "previous_id"]
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, position long, nth long, previous_id long"


def _reader(folder: str):
    """mapInArrow body: (file, offset, length, position, nth, previous_id), by file and offset, to the records' own fields and their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        name = source = None
        try:
            for batch in batches:
                out = []
                for file, offset, length in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                    if file != name:
                        if source:
                            source.close()
                        name, source = file, store.open_input_file(f"{path}/{file}")
                    headers, payload = parse(zlib.decompress(source.read_at(length, offset), 31))
                    number = lambda k: int(v) if (v := headers.get(k, "").removeprefix("<urn:page:").removesuffix(">")) else None
                    claimed = headers["warc-payload-digest"].removeprefix("sha256:")
                    whole = headers["warc-type"] == "response"
                    digest = hashlib.sha256(payload).hexdigest() if whole else claimed
                    if digest != claimed:
                        raise ValueError(f"{file}: the payload at {offset} does not match its digest")
                    out.append((number("warc-record-id"), len(payload) if whole else None, digest, headers["warc-type"], number("warc-refers-to")))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                own = [pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *batch.columns[3:]], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *PLACED])
        finally:
            if source:
                source.close()

    return run


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, position, nth, previous_id of every record of a merged index."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = index.select("file", "offset", "length", *PLACED).repartition(n, "file").sortWithinPartitions("file", "offset")
    got = written(listed.mapInArrow(_reader(folder), READ), "warc-read")
    whole = got.where("record_type = 'response'").groupBy(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest")).agg(F.min("payload_bytes").alias("r_bytes"))
    full = got.join(whole, (got["refers_to"] == whole["r_id"]) & (got["payload_digest"] == whole["r_digest"]), "left")
    return full.select("page_id", F.coalesce("payload_bytes", "r_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", *PLACED)


#: Pages have no capture time of their own; ids stand in for it, within ten years of this second.
EPOCH, SPAN = 1_704_067_200, 315_360_000


def archived(pages: DataFrame) -> DataFrame:
    """Write, merge the index, read back through it."""
    folder = scratch(pages.sparkSession, "warc")
    at = F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id").try_cast("long"), F.lit(0)), F.lit(SPAN))
    runs = write_archives(pages.select("page_id", "url", "html"), folder, at)
    return read_archives(merge_index(runs), folder)
