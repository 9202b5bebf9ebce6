"""A paged REST collection as a Spark data source, to read and to write.

Writing sends rows(method, path, external_id, body) in the order they come.  A task that
is run again does not double what it did: a POST first looks its external id up and, where
the record is there, changes what differs; a DELETE of what is gone is done.  A record
takes so many changes a minute (`changesPerMinute`), further ones wait, so rows of one
record belong into one task in order (see `requests`).  A refusal (422) fails the job, or
with `refused` = `rows` is an outcome like others.  Outcomes are files named for their
attempt in `outcomes`, a folder that all share; only those that the job's commit lists count.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from vellum.sources.folder_service import FolderService
from vellum.sources.shared import filesystem, read_bytes, write_bytes


class RestError(RuntimeError):
    """An answer that is not a success; the token never appears in it."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message[:300])
        self.status = status


def token_from(env: str, path: str | None = None) -> str:
    """The token of an environment variable, else of a file."""
    if value := os.environ.get(env):
        return value.strip()
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return f.read().strip()
    raise RestError(f"no token: set {env}")


def open_url(url: str, headers: dict[str, str], method: str = "GET", data: bytes | None = None) -> tuple[int, dict[str, str], bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=data, headers=headers, method=method), timeout=60) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


class Client:
    """Requests with retries on 429; opener and sleeper can be replaced in tests."""

    def __init__(self, base: str, token: str, opener: Callable = open_url, sleep: Callable = time.sleep, retries: int = 3):
        self.base, self._token, self.opener, self.sleep, self.retries = base.rstrip("/"), token, opener, sleep, retries

    def __repr__(self) -> str:
        return f"Client({self.base!r})"

    def _answer(self, path: str, *sent, **more_headers: str) -> tuple[dict[str, str], object]:
        asked = {"Authorization": f"Bearer {self._token}", "Accept": "application/json", **more_headers}
        for attempt in range(self.retries + 1):
            status, headers, body = self.opener(f"{self.base}/{path}", asked, *sent)
            headers = {k.lower(): v for k, v in headers.items()}
            if status != 429 or attempt == self.retries:
                break
            self.sleep(float(headers.get("retry-after", headers.get("ratelimit-reset", 2**attempt))))
        if status >= 400:
            raise RestError(f"{status} for {path}: {body.decode('utf-8', 'replace').replace(self._token, '***')}", status)
        return headers, json.loads(body or b"null")

    def get(self, path: str) -> tuple[dict[str, str], object]:
        return self._answer(path)

    def send(self, method: str, path: str, body: object = None) -> object:
        """POST, PATCH or DELETE."""
        return self._answer(path, method, None if body is None else json.dumps(body, ensure_ascii=False).encode(), **{"Content-Type": "application/json"})[1]

    def by_external_id(self, path: str, external_id: str) -> dict | None:
        """The only live record of an external id; more than one is an error."""
        found = [r for r in self.get(f"{path}?external_id={urllib.parse.quote(external_id, safe='')}")[1] or [] if str(r.get("external_id")) == external_id and not r.get("trashed")]
        if len(found) > 1:
            raise RestError(f"{len(found)} records of {path} with external id {external_id}: {', '.join(str(r['id']) for r in found)}")
        return found[0] if found else None

    def pages(self, path: str, size: int = 100) -> int:
        headers, _ = self.get(f"{path}{'&' if '?' in path else '?'}page=1&limit={size}")
        return int(headers.get("total-pages", 1) or 1)

    def page(self, path: str, no: int, size: int = 100) -> list:
        return list(self.get(f"{path}{'&' if '?' in path else '?'}page={no}&limit={size}")[1] or [])

    def all_pages(self, path: str, size: int = 100) -> Iterator[tuple[int, list]]:
        """(number, records) of each page; the first one tells how many there are."""
        no, last = 1, 1
        while no <= last:
            headers, rows = self.get(f"{path}{'&' if '?' in path else '?'}page={no}&limit={size}")
            last = int(headers.get("total-pages", 1) or 1)
            yield no, list(rows or [])
            no += 1


class Page(InputPartition):
    def __init__(self, no: int):
        self.no = no


class Parts(InputPartition):
    """Filters of a collection, each read from its first page to its last by one task."""

    def __init__(self, filters: list[str]):
        self.filters = filters


def client_of(options: dict[str, str], opener: Callable | None = None) -> Client:
    """The client that the options name; `folder` makes a folder of records answer in place of a server."""
    if folder := options.get("folder"):
        return Client(options.get("base", "folder://"), "none", opener or FolderService(folder))
    token = options.get("token") or token_from(options.get("tokenenv") or options.get("tokenEnv", "REST_TOKEN"), options.get("tokenfile") or options.get("tokenFile"))
    return Client(options["base"], token, opener or open_url)


class RestReader(DataSourceReader):
    """One partition for each page, and a page is one request; or with `parts` (filters such as `shelf=0af`, with & between them)
    the filters dealt over `tasks` partitions, so that neither the driver nor a page meets the whole collection."""

    def __init__(self, options: dict[str, str], opener: Callable | None = None):
        self.options, self.opener = dict(options), opener

    def client(self) -> Client:
        return client_of(self.options, self.opener)

    def size(self) -> int:
        return int(self.options.get("pagesize") or self.options.get("pageSize", 100))

    def partitions(self) -> list[InputPartition]:
        if parts := self.options.get("parts"):
            filters, tasks = parts.split("&"), int(self.options.get("tasks", 64))
            return [Parts(filters[i::tasks]) for i in range(min(tasks, len(filters)))]
        return [Page(n + 1) for n in range(self.client().pages(self.options["path"], self.size()))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client, path = self.client(), self.options["path"]
        if isinstance(partition, Page):
            pages = [(partition.no, client.page(path, partition.no, self.size()))]
        else:
            pages = ((no, rows) for f in partition.filters for no, rows in client.all_pages(f"{path}?{f}", self.size()))
        for no, rows in pages:
            for row in rows:
                yield (no, json.dumps(row, ensure_ascii=False))


class Budget:
    """So many changes of a record in so many seconds; the next one waits."""

    def __init__(self, changes: int, seconds: float = 60, clock: Callable[[], float] = time.monotonic, sleep: Callable = time.sleep):
        self.changes, self.seconds, self.clock, self.sleep = changes, seconds, clock, sleep
        self.past: dict[str, deque] = {}
        self.recent: deque[tuple[float, str]] = deque()  # the same changes in the order of time

    def _forget(self, until: float) -> None:
        """Drop the changes up to a time; each is met once, and records without any need no memory."""
        while self.recent and self.recent[0][0] <= until:
            record = self.recent.popleft()[1]
            self.past[record].popleft()
            if not self.past[record]:
                del self.past[record]

    def spend(self, record: str) -> None:
        self._forget(self.clock() - self.seconds)
        while len(past := self.past.get(record, ())) >= self.changes:
            first = past[0]
            self.sleep(max(0.0, first + self.seconds - self.clock()))
            self._forget(max(first, self.clock() - self.seconds))
        now = self.clock()
        self.past.setdefault(record, deque()).append(now)
        self.recent.append((now, record))


@dataclass
class Sent(WriterCommitMessage):
    outcomes: str
    rows: int


class RestWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str], opener: Callable | None = None, budget: Budget | None = None):
        self.options, self.columns, self.opener = dict(options), columns, opener
        self.refused = self.options.get("refused", "fail")
        if self.refused not in ("fail", "rows"):
            raise ValueError("refused is fail or rows")
        self.budget = budget

    def one(self, client: Client, method: str, path: str, external_id: str | None, body: str | None) -> str:
        """Send one request; what came of it."""
        wanted = json.loads(body) if body else None
        if method == "POST" and external_id is not None:
            there = client.by_external_id(path, external_id)
            if there is None:
                client.send("POST", path, wanted)
                return "created"
            differs = {k: v for k, v in (wanted or {}).items() if there.get(k) != v}
            if not differs:
                return "present"
            client.send("PATCH", f"{path}/{there['id']}", differs)
            return "changed"
        if method == "DELETE" and external_id is not None:
            there = client.by_external_id(path, external_id)
            if there is None:
                return "gone"
            path = f"{path}/{there['id']}"
        try:
            client.send(method, path, wanted)
        except RestError as e:
            if method == "DELETE" and e.status == 404:
                return "gone"
            raise
        return {"POST": "created", "PATCH": "changed", "DELETE": "deleted"}[method]

    def write(self, rows: Iterator) -> Sent:
        client, name, out = client_of(self.options, self.opener), f"{uuid.uuid4().hex}.jsonl", []
        budget = self.budget or Budget(int(self.options.get("changesperminute", 5)))
        for row in rows:
            r = dict(zip(self.columns, row, strict=True))
            method, path, external_id = r["method"].upper(), r["path"], r.get("external_id")
            budget.spend(f"{path}#{external_id}")
            try:
                state, message = self.one(client, method, path, external_id, r.get("body")), None
            except RestError as e:
                if self.refused != "rows" or e.status != 422:
                    raise
                state, message = "refused", str(e)
            out.append({"method": method, "path": path, "external_id": external_id, "state": state, "message": message})
        if folder := self.options.get("outcomes"):
            system, base = filesystem(folder)
            write_bytes(system, f"{base}/{name}", "".join(json.dumps(o) + "\n" for o in out).encode())
        return Sent(name, len(out))

    def commit(self, messages: list[Sent | None]) -> None:
        if folder := self.options.get("outcomes"):
            system, base = filesystem(folder)
            write_bytes(system, f"{base}/_committed", json.dumps([m.outcomes for m in messages if m]).encode())

    def abort(self, messages: list[Sent | None]) -> None:
        """What was sent stays sent; without a commit its outcomes do not count, and the job can be run again."""


class RestDataSource(DataSource):
    """spark.read.format("rest").option("base", ...).option("path", ...): page, json; to write, rows(method, path, external_id, body)."""

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return "page int, json string"

    def reader(self, schema) -> RestReader:
        return RestReader(self.options)

    def writer(self, schema, overwrite: bool) -> RestWriter:
        return RestWriter(self.options, schema.names)


def requests(planned: DataFrame, path: str, key: str = "key", tasks: int | None = None) -> DataFrame:
    """method, path, external_id, body of a plan's steps(key, step, request, body); a record's steps are in one task, in order."""
    rows = planned.where("request <> 'report'").select(F.upper("request").alias("method"), F.lit(path).alias("path"), F.col(key).cast("string").alias("external_id"), F.when(F.col("request") != "delete", F.col("body")).alias("body"), "step")
    return dealt(rows, tasks).sortWithinPartitions("external_id", "step").drop("step")


def dealt(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows with external_id, those of a record in one task.  A request costs time and few bytes, so the number of tasks is given and not left to the size of the rows."""
    spark = rows.sparkSession
    return rows.repartition(tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "external_id")


def send(rows: DataFrame, outcomes: str, **options: str) -> DataFrame:
    """Write rows(method, path, external_id, body); gives the committed outcomes."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(RestDataSource)
    writer = rows.write.format("rest").mode("append").option("outcomes", outcomes)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save()
    system, base = filesystem(outcomes)
    names = json.loads(read_bytes(system, f"{base}/_committed") or b"[]")
    schema = "method string, path string, external_id string, state string, message string"
    return spark.read.schema(schema).json([f"{outcomes}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def poll(check: Callable[[], object], done: Callable[[object], bool], every: float = 3, patience: float = 300, sleep: Callable = time.sleep):
    """Ask again and again until done; a time-out is an error."""
    waited = 0.0
    while not done(x := check()):
        if waited >= patience:
            raise RestError(f"not done after {patience:g} s")
        sleep(every)
        waited += every
    return x


def short(value: object, width: int = 60) -> str:
    """A value for display, cut."""
    text = re.sub(r"\s+", " ", value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    return text if len(text) <= width else text[: width - 3] + "..."
