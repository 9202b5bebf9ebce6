"""Sources and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.sources import files, literals, office, package, rest
from vellum.streaming import incremental


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_unzip_and_submissions(spark):
    data = zipped(**{"a/b.txt": "x", "__MACOSX/a": "y", "~$t.docx": "z", "c.png": "w"})
    df = spark.createDataFrame([("z", data), ("bad", b"no zip"), ("none", None)], "path string, content binary")
    assert sorted(r["entry"] for r in files.unzip(df).collect()) == ["a/b.txt", "c.png"]
    subs = spark.createDataFrame([(1, "2024", 0, "s.zip", data), (1, "2024", 1, "q.pdf", b"p"), (2, "2023", 0, "~$x.docx", b"t")], "student_id long, sub_date string, ord int, name string, content binary")
    assert sorted((r["student_id"], r["ord"], r["name"]) for r in files.expand_submissions(subs).collect()) == [(1, 0, "a/b.txt"), (1, 0, "c.png"), (1, 1, "q.pdf")]
    kinds = spark.createDataFrame([("a.DOCX",), ("~$a.docx",), ("x/b.png",), ("c.ino",), ("d",)], "name string").select(files.file_kind().alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["docx", None, "image", "code", "other"]
    text = spark.createDataFrame([("é".encode(),), ("é".encode("cp1252"),), (b"\xef\xbb\xbfa",)], "content binary").select(files.decoded().alias("t"))
    assert [r["t"] for r in text.collect()] == ["é", "é", "a"]


W = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"


def test_docx(spark):
    p = lambda t, props="", run="": f"<w:p>{props}<w:r>{run}<w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t)}</w:tc>"
    body = (
        p("Titel", "<w:pPr><w:pStyle w:val='Heading1'/></w:pPr>")
        + f"<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>a</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>b</w:t></w:r><w:r><w:t>c</w:t></w:r></w:p>"
        + p("i1", "<w:pPr><w:numPr><w:ilvl w:val='0'/><w:numId w:val='5'/></w:numPr></w:pPr>")
        + f"<w:tbl><w:tr>{cell('x', '<w:gridSpan w:val=\"2\"/>')}{cell('y', '<w:vMerge w:val=\"restart\"/>')}</w:tr><w:tr>{cell('p')}{cell('q')}{cell('', '<w:vMerge/>')}</w:tr></w:tbl>"
    )
    data = zipped(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})
    got = office.read_docx(spark.createDataFrame([("d", data), ("bad", b"x")], "path string, content binary")).collect()
    assert [r["error"] is not None for r in got if r["path"] == "bad"] == [True]
    blocks = [r for r in got if r["path"] == "d"]
    assert [b["kind"] for b in blocks] == ["heading", "paragraph", "item", "table", "cell", "cell", "cell", "cell"]
    assert [(r["text"], r["bold"]) for r in blocks[1]["runs"]] == [("ab", True), ("c", False)] and blocks[2]["num_id"] == 5
    assert [(b["row"], b["col"], b["col_span"], b["row_span"]) for b in blocks if b["kind"] == "cell"] == [(0, 0, 2, 1), (0, 2, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)]


def test_literals_and_manifest():
    text = "// c\nwindow.X = { 'a b': [1, -2.5, true, null,], c: `t`, d: 'it\\'s' /* x */ };\nrest"
    assert json.loads(literals.literal_json(text)) == {"a b": [1, -2.5, True, None], "c": "t", "d": "it's"}
    assert literals.literal_json("x = {a: ") is None and literals.literal_json("nothing") is None
    m = literals.manifest_modules("x = { m: { categories: [ { name: 'C', topics: [ { id: 'i', name: 'N', href: 'h' } ] } ] } };")
    assert m == [{"module": "m", "n_categories": 1, "topics": [{"id": "i", "name": "N", "href": "h"}]}]


def test_package(spark):
    xml = "<manifest><organizations><organization><item isvisible='False'><title>M</title><item identifierref='r1'><title>P</title></item></item><item identifierref='r2'><title>D</title></item></organization></organizations><resources><resource identifier='r1' href='a%20b.html'/><resource identifier='r2' href='x\\d.pdf'/></resources></manifest>"
    df = spark.createDataFrame([("p", zipped(**{"k/imsmanifest.xml": xml, "k/sub/imsmanifest.xml": "<x/>", "k/a b.html": ""})), ("q", zipped(**{"z.html": "", "y.html": ""}))], "path string, content binary")
    got = package.topics(files.unzip(df))
    assert sorted((r["path"], r["ord"], r["title"], r["kind"], r["hidden"], r["zip_path"]) for r in got.collect()) == [("p", 1, "P", "page", True, "k/a b.html"), ("p", 2, "D", "document", False, "k/x/d.pdf"), ("q", 1, "y", "page", False, "y.html"), ("q", 2, "z", "page", False, "z.html")]
    assert [r["title"] for r in package.only(got, ["m > p"]).collect()] == ["P"]
    assert package.dropboxes("<d><folder name='N' resource_code='C'><text>t</text></folder></d>") == [{"code": "C", "name": "N", "html": "t"}]


def test_rest_client():
    asked, waits = [], []

    def opener(url, headers):
        asked.append(url)
        assert headers["Authorization"] == "Bearer secret"
        if len(asked) == 1:
            return 429, {"Retry-After": "2"}, b""
        if "bad" in url:
            return 500, {}, b"oops secret"
        return 200, {"Total-Pages": "2"}, json.dumps([{"id": len(asked)}]).encode()

    c = rest.Client("https://x/", "secret", opener, waits.append)
    assert c.pages("things") == 2 and waits == [2.0] and c.page("things?y=1", 2) == [{"id": 3}] and asked[-1].endswith("things?y=1&page=2&limit=100")
    with pytest.raises(rest.RestError) as e:
        c.get("bad")
    assert "secret" not in str(e.value) and "secret" not in repr(c) and e.value.status == 500
    r = rest.RestReader({"base": "https://x", "path": "things", "token": "secret"}, opener)
    assert [json.loads(row[1]) for p in r.partitions() for row in r.read(p)]
    with pytest.raises(rest.RestError):
        rest.poll(lambda: 1, lambda x: x > 1, 1, 3, lambda s: None)


def test_change_feed_over_waves(spark, tmp_path):
    schema = "code string, hash string, ord long"
    for i, wave in enumerate([[("a", "1", 0), ("b", "1", 0)], [("a", "1", 1), ("b", "2", 1)], [("b", "2", 2), ("c", "1", 2)]]):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = incremental.change_feed(incremental.folder_stream(spark, str(tmp_path / "in"), schema), "code", "hash", "ord").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["key"], r["hash"], r["status"]) for r in got) == [("a", "1", "new"), ("b", "1", "new"), ("b", "2", "changed"), ("c", "1", "new")]


def test_snapshot(spark, tmp_path):
    from vellum.streaming.snapshot import Snapshot

    make = lambda *r: spark.createDataFrame(list(r), "k string, t int, v string, gone boolean")
    path = f"file://{tmp_path}/snap"
    snap = Snapshot(path, ["k"], ["t"], buckets=64, keep=2, deleted="gone")
    assert snap.read(spark) is None and snap.merge(make(), 0) == {"buckets": [], "removed": []} and snap.read(spark) is None
    snap.merge(make(*((f"k{i}", 1, "x" * 50, None) for i in range(500))), 1)
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "snap").rglob("*.parquet"))
    whole = size()
    got = snap.merge(make(("k7", 2, "new", False), ("k8", 0, "old", None), ("k7", 1, "x", None), ("k9", 3, None, True)), 2)
    assert 1 <= len(got["buckets"]) <= 3 and size() - whole < whole / 8  # what a batch writes follows the batch
    table = lambda: {r["k"]: (r["t"], r["v"]) for r in snap.read(spark).collect()}
    now = table()
    assert len(now) == 499 and now["k7"] == (2, "new") and now["k8"] == (1, "x" * 50) and "k9" not in now
    assert snap.merge(make(("k7", 9, "again", None)), 2) == {"buckets": [], "removed": []} and table() == now  # the same batch once more
    snap.merge(make(("k7", 3, "b3", None)), 3)
    removed = snap.merge(make(("k7", 4, "b4", None)), 4)["removed"]
    assert removed and not any((tmp_path / "snap" / r).exists() for r in removed) and table()["k7"] == (4, "b4")
    assert Snapshot(path, ["k"], ["t"], buckets=7).buckets == 64  # fixed once it exists
    # a batch that died before its manifest is not seen, and goes when the snapshot is compacted
    (tmp_path / "snap/v0000000099-dead").mkdir()
    before = table()
    assert snap.compact(spark) >= 2 and table() == before and len([f for f in (tmp_path / "snap").iterdir() if f.is_dir()]) == 1
    snap.merge(make(*((f"k{i}", 99, None, True) for i in range(500))), 5)
    assert snap.read(spark) is None


def test_latest_per_kind_closes_owners(spark, tmp_path):
    import datetime as dt
    import os

    from vellum.streaming import latest

    latest.uses_rocksdb(spark)
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    waves = [[("a", "docx", "s1", at(1), 1), ("a", "docx", "s2", at(1), 2), ("b", "zip", "s3", at(1, 5), 3)], [("a", "docx", "s0", at(0, 55), 9), ("a", "pdf", "s4", at(1, 30), 4), (None, "pdf", "x", at(1, 20), 1)], [("b", "zip", "s5", at(5), 5)], [("z", "q", "s6", at(9), 6)]]
    schema = "who string, kind string, sub string, at timestamp, ord long"
    (tmp_path / "in").mkdir()
    for i, w in enumerate(waves):
        spark.createDataFrame(w, schema).coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        f = next((tmp_path / f"w{i}").glob("*.parquet")).rename(tmp_path / f"in/{i}.parquet")
        os.utime(f, (1e9 + i, 1e9 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = []
    q = latest.latest_per_kind(stream, "who", "kind", "sub", "at", "ord").writeStream.foreachBatch(lambda b, i: out.extend((i, r["owner"], r["kind"], r["submission"], r["at"], r["status"]) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    changes = [r for r in out if r[-1] != "final"]
    assert sorted(changes) == [(0, "a", "docx", "s2", at(1), "new"), (0, "b", "zip", "s3", at(1, 5), "new"), (1, "a", "pdf", "s4", at(1, 30), "new"), (2, "b", "zip", "s5", at(5), "replaced"), (3, "z", "q", "s6", at(9), "new")]
    assert {r[1:4] for r in out if r[-1] == "final"} >= {("a", "docx", "s2"), ("a", "pdf", "s4")}


def test_directory_corpus(spark, tmp_path):
    from vellum.corpus import from_directory

    (tmp_path / "Labo").mkdir()
    (tmp_path / "Labo/a.html").write_text("<p>é — x</p>", encoding="utf-8")
    c = from_directory(spark, str(tmp_path), {}, ["Labo/a.html"])
    assert [tuple(r) for r in c.pages.select("path", "html", "is_audit").collect()] == [("Labo/a.html", "<p>é — x</p>", True)]
    assert files.git_tracked(str(tmp_path)) is None and F


def test_every_text_goes_through_archives(spark):
    """Texts of any length, in several archives of bounded size; equal and missing ids keep their rows."""
    from vellum import queries

    texts = [(i, f"text {i} " * (i * 40), "en" if i % 2 else None) for i in range(1, 40)] + [(1, "", "en"), (None, "x" * 300, "de"), (50, None, "en")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = queries.unzipped(docs, archive_bytes=20_000).collect()
    assert sorted(((r["doc_id"], bytes(r["bytes"]).decode()) for r in got), key=repr) == sorted(((i, t) for i, t, _ in texts if t is not None), key=repr)


def test_unzip_query_shows_every_document(spark):
    from vellum import queries

    d = "/root/testdata/sf0.001"
    assert queries.QUERIES["src9_unzip"](spark, d).count() == spark.read.parquet(f"{d}/documents.parquet").count()
