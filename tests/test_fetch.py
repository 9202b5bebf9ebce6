"""Fetching: what is taken, what is not, how often a host is asked, and what the cache knows."""

from pyspark.sql import functions as F

from vellum.sources import fetch

GIF = b"GIF89a\x01\x00\x01\x00"


def test_judged():
    assert fetch.judged(200, "image/GIF; charset=x", GIF, 100) == ("kept", ".gif")
    assert fetch.judged(200, "image/png", GIF, 100)[0] == "not what it says" and fetch.judged(200, "image/gif", b"<html>", 100)[0] == "not what it says"
    assert fetch.judged(200, "", GIF, 100)[0] == "type not taken" and fetch.judged(503, "image/gif", GIF, 100)[0] == "status 503"
    assert fetch.judged(200, "image/gif", GIF, 10)[0] == "kept" and fetch.judged(200, "image/gif", GIF, 9)[0] == "too large"


def test_pace():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(round(s, 6))
        now[0] += s

    p = fetch.Pace(2.0, 3, lambda: now[0], sleep)
    for _ in range(5):
        p.wait("a")
    p.wait("b")
    assert waits == [0.5, 0.5]
    now[0] += 100
    for _ in range(3):
        p.wait("a")
    assert len(waits) == 2
    for i in range(12_000):
        p.wait(f"h{i}")
    now[0] += 100
    p.wait("z")
    assert len(p.left) < 10_002


def test_fetched(spark, tmp_path):
    web = tmp_path / "web"
    web.mkdir()
    for name, head, body in (("https://a/1", '{"status": 200, "type": "image/gif"}', GIF), ("http://b/2", '{"status": 200, "type": "image/gif"}', GIF), ("http://b/3", '{"status": 200, "type": "image/gif"}', GIF + b"x" * 500)):
        (web / fetch.FolderWeb.name(name)).write_bytes(head.encode() + b"\n" + body)
    cache = f"file://{tmp_path}/cache"
    urls = spark.createDataFrame([(u,) for u in ("https://a/1", " https://a/1 ", "http://b/2", "http://b/3", "http://gone/4", "data:x", "", None)], "url string")
    run = lambda df: {r["url"]: (r["status"], r["bytes"]) for r in fetch.fetched(df, cache, max_bytes=100, per_second=1e6, web=fetch.FolderWeb(f"file://{web}")).collect()}
    want = {"https://a/1": ("kept", 10), "http://b/2": ("kept", 10), "http://b/3": ("too large", None), "http://gone/4": ("unreachable: URLError", None), "data:x": ("not http", None)}
    assert run(urls) == want
    assert [f.read_bytes() for f in (tmp_path / "cache").glob("??/*")] == [GIF]  # equal contents once
    for f in web.iterdir():
        f.unlink()
    again = run(urls)
    assert again["https://a/1"] == ("cached", 10) and again["http://b/3"][0] == "unreachable: URLError"
    assert run(urls.limit(0)) == {} and F
