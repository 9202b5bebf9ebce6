"""Sinks: what tasks that run twice, fail or are refused leave behind."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.sources import filesink, rest
from vellum.sources.folder_service import SHELVES, FolderService


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_files_are_published_once(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    df = spark.createDataFrame([("a/x.html", "één"), ("a/b/y.html", ""), ("z.html", None)], "path string, content string")
    assert rows(filesink.write_files(df, root)) == [("a/b/y.html", 0, "written"), ("a/x.html", 5, "written"), ("z.html", 0, "written")]
    assert (tmp_path / "site/a/x.html").read_text() == "één"
    new = df.withColumn("content", F.when(F.col("path") == "a/x.html", "two").otherwise(F.col("content")))
    job = filesink.stage(new, root)
    assert (tmp_path / "site/a/x.html").read_text() == "één"  # staged only
    want = [("a/b/y.html", 0, "unchanged"), ("a/x.html", 3, "written"), ("z.html", 0, "unchanged")]
    assert rows(filesink.publish(spark, root, job)) == want
    assert {s for *_, s in rows(filesink.publish(spark, root, job))} == {"unchanged"}
    assert rows(filesink.write_files(df.limit(0), root)) == []
    with pytest.raises(RuntimeError):
        filesink.committed(spark, root, "never")


def test_attempts_that_fail_or_repeat_leave_nothing(tmp_path):
    root = f"file://{tmp_path}/site"
    w = filesink.StagingWriter({"path": root, "job": "j"}, ["path", "content"])
    lost = w.write(iter([("a", "1")]))  # a task whose answer was lost, and its second attempt
    kept = w.write(iter([("a", "1"), ("a", "1")]))
    assert lost.manifest != kept.manifest and kept.files == 1
    w.commit([kept, None])
    assert json.loads((tmp_path / "site/.staged/j/_committed").read_text()) == {"manifests": [kept.manifest], "files": 1}
    other = filesink.StagingWriter({"path": root, "job": "k"}, ["path", "content"])
    other.abort([other.write(iter([("b", "2")])), None])
    assert not list((tmp_path / "site/.staged/k").iterdir())
    for bad in ("/etc/x", "../x", "a/../../x", "", ".staged/x", "a//b"):
        with pytest.raises(ValueError):
            w.write(iter([(bad, "x")]))
    with pytest.raises(ValueError, match="two contents"):
        w.write(iter([("a", "1"), ("a", "2")]))


def test_a_failed_job_publishes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    df = spark.range(40).select(F.when(F.col("id") == 33, F.lit("../out")).otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("path"), F.lit("x").alias("content")).repartition(4)
    with pytest.raises(Exception, match="not a path below the root"):
        filesink.write_files(df, root, "bad")
    assert not [p for p in (tmp_path / "site").iterdir() if p.name != ".staged"]
    with pytest.raises(RuntimeError, match="not committed"):
        filesink.publish(spark, root, "bad")


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "log")
    filesink.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), path, ["k"])
    before = {f.name for f in (tmp_path / "log/k=2").iterdir()}
    filesink.replace_partitions(spark.createDataFrame([(1, "c"), (3, "d")], "k int, x string"), path, ["k"])
    assert rows(spark.read.parquet(path).select("k", "x")) == [(1, "c"), (2, "b"), (3, "d")] and {f.name for f in (tmp_path / "log/k=2").iterdir()} == before


def writer(folder, opener=None, **options):
    return rest.RestWriter({"folder": folder, "outcomes": folder + "-out", **options}, ["method", "path", "external_id", "body"], opener, rest.Budget(1000))


def test_a_task_retry_leaves_no_double(tmp_path):
    folder = f"file://{tmp_path}/s"
    service, sent = FolderService(folder), []

    def dies(url, headers, method="GET", data=None):
        if method != "GET":
            sent.append(method)
            if len(sent) == 3:
                raise ConnectionError("executor lost")
        return service(url, headers, method, data)

    batch = [("POST", "items", f"e{i}", json.dumps({"external_id": f"e{i}", "v": i})) for i in range(5)]
    with pytest.raises(ConnectionError):
        writer(folder, dies).write(iter(batch))
    w = writer(folder)
    done = w.write(iter(batch))
    w.commit([done])
    states = [json.loads(x)["state"] for x in (tmp_path / f"s-out/{done.outcomes}").read_text().splitlines()]
    assert states == ["present", "present", "created", "created", "created"]
    client = rest.client_of({"folder": folder})
    assert sorted(r["v"] for r in client.page("items", 1)) == list(range(5))
    w.write(iter([("DELETE", "items", "e1", None), ("POST", "items", "e1", batch[1][3]), ("DELETE", "items", "e9", None)]))
    w.write(iter([("DELETE", "items", "e1", None), ("POST", "items", "e1", batch[1][3])]))  # the replacement, run again
    assert sorted(r["v"] for r in client.page("items", 1)) == list(range(5))
    record = client.by_external_id("items", "e0")
    w.write(iter([("PATCH", f"items/{record['id']}", None, '{"v": 7}'), ("DELETE", "items/no-such", None, None)]))
    assert client.by_external_id("items", "e0")["v"] == 7
    client.send("POST", "items", {"external_id": "e0"})
    with pytest.raises(rest.RestError, match="2 records of items with external id e0"):
        client.by_external_id("items", "e0")


def test_refusals(tmp_path):
    folder = f"file://{tmp_path}/s"
    bad = [("POST", "items", "x", '{"external_id": "x", "refuse": 1}'), ("POST", "items", "y", '{"external_id": "y"}')]
    with pytest.raises(rest.RestError) as e:
        writer(folder).write(iter(bad))
    assert e.value.status == 422
    done = writer(folder, refused="rows").write(iter(bad))
    out = [json.loads(x) for x in (tmp_path / f"s-out/{done.outcomes}").read_text().splitlines()]
    assert [o["state"] for o in out] == ["refused", "created"] and "422" in out[0]["message"]
    with pytest.raises(rest.RestError):  # others fail always
        writer(folder, refused="rows").write(iter([("PATCH", "items/none", None, "{}")]))
    with pytest.raises(ValueError):
        writer(folder, refused="maybe")


def test_budget_waits():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    b = rest.Budget(5, 60, lambda: now[0], sleep)
    for _ in range(5):
        b.spend("a")
    now[0] += 10
    b.spend("a")
    b.spend("other")
    assert waits == [50.0]
    for i in range(12_000):
        b.spend(f"r{i}")
    now[0] += 100
    b.spend("last")
    assert len(b.past) < 10


def test_requests_keep_a_records_steps_together(spark):
    plan = spark.createDataFrame([("k1", 1, "post", "{}"), ("k1", 0, "delete", "{}"), ("k2", 0, "report", None), ("k3", 0, "post", "{}")], "key string, step int, request string, body string")
    got = rest.requests(plan, "items", tasks=3)
    assert [tuple(r) for r in got.where("external_id = 'k1'").collect()] == [("DELETE", "items", "k1", None), ("POST", "items", "k1", "{}")]
    assert got.count() == 3


def test_retries_and_secrets():
    answers = [(429, {"RateLimit-Reset": "7"}, b""), (500, {}, b"token secret seen")]
    waits = []
    c = rest.Client("https://x", "secret", lambda *a: answers.pop(0), waits.append)
    with pytest.raises(rest.RestError) as e:
        c.send("PATCH", "p", {"a": 1})
    assert waits == [7.0] and "secret" not in str(e.value)


def test_budget_looks_at_each_change_once():
    """Many records within one minute: what a change costs does not grow with the records before it."""
    calls = [0]

    def clock():
        calls[0] += 1
        return calls[0] * 1e-6

    b = rest.Budget(5, 60, clock)
    for i in range(12_000):
        b.spend(f"r{i}")
    assert len(b.past) == 12_000 and calls[0] <= 4 * 12_000


def test_budget_waits_for_every_change_again():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    b = rest.Budget(2, 60, lambda: now[0], sleep)
    for at in (0, 20, 30, 65, 70, 200):
        now[0] = max(now[0], at)
        b.spend("a")
    assert waits == [30.0, 15.0, 40.0] and len(b.past) == 1


def test_few_bytes_go_to_many_tasks(spark, tmp_path):
    """One small partition of requests is dealt out, a record's requests to one task."""
    key = F.concat(F.lit("e"), (F.col("id") % 30).cast("string"))
    posts = spark.range(60).coalesce(1).select(F.lit("POST").alias("method"), F.lit("items").alias("path"), key.alias("external_id"), F.to_json(F.struct(key.alias("external_id"))).alias("body"))
    out = f"file://{tmp_path}/out"
    done = rest.send(rest.dealt(posts), out, folder=f"file://{tmp_path}/s")
    assert {(r["state"], r["count"]) for r in done.groupBy("state").count().collect()} == {("created", 30), ("present", 30)}
    assert len(json.loads((tmp_path / "out/_committed").read_text())) >= 2
    plan = spark.createDataFrame([(f"k{i}", 0, "post", "{}") for i in range(50)], "key string, step int, request string, body string")
    used = rest.requests(plan, "items").groupBy(F.spark_partition_id()).count()
    assert used.count() >= 2


def test_shelves_are_read_without_the_whole_collection(tmp_path):
    """All shelves give what the collection has, each record once, and list each file once or twice and not once for each page."""
    folder, listed = f"file://{tmp_path}/s", []

    class Counting(FolderService):
        def _files(self, name):
            found = super()._files(name)
            listed.append(len(found))
            return found

    w = writer(folder)
    w.write(iter([("POST", "items", f"e{i}", json.dumps({"external_id": f"e{i}"})) for i in range(300)]))
    w.write(iter([("DELETE", "items", f"e{i}", None) for i in range(0, 300, 3)]))
    reader = rest.RestReader({"folder": folder, "path": "items", "pageSize": "2", "parts": "&".join(f"shelf={x}" for x in SHELVES), "tasks": "5"}, Counting(folder))
    parts = reader.partitions()
    assert len(parts) == 5 and listed == []  # the driver asks for nothing
    got = [json.loads(r)["external_id"] for p in parts for _, r in reader.read(p)]
    assert sorted(got) == sorted(f"e{i}" for i in range(300) if i % 3) and sum(listed) <= 400
    plain = rest.RestReader({"folder": folder, "path": "items", "pageSize": "50"})
    assert sorted(json.loads(r)["external_id"] for p in plain.partitions() for _, r in plain.read(p)) == sorted(got)


def test_pages_of_a_part_are_all_read(tmp_path):
    """A shelf of more records than a page holds."""
    folder = f"file://{tmp_path}/s"
    client = rest.client_of({"folder": folder})
    for i in range(5):
        client.send("POST", "items", {"external_id": "same", "v": i})
    reader = rest.RestReader({"folder": folder, "path": "items", "pageSize": "2", "parts": "&".join(f"shelf={x}" for x in SHELVES)})
    got = [(no, json.loads(r)["v"]) for p in reader.partitions() for no, r in reader.read(p)]
    assert sorted(v for _, v in got) == list(range(5)) and sorted(no for no, _ in got) == [1, 1, 2, 2, 3]
