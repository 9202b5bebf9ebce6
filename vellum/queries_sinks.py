"""Queries that write and read back: staged files, sections, and a service of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.corpus import Corpus
from vellum.functions import text as tx
from vellum.functions.images import cropped, figure_cm, image_info_udf, is_background
from vellum.functions.segments import segments_udf
from vellum.operators import assemble, feedback, reconcile, rewrite, worklist
from vellum.operators.repair import repaired
from vellum.queries import long, query
from vellum.sources import fetch, filesink, folder_service, rest, sheets
from vellum.sources.shared import new_path


def read_back(spark, root: str, pattern: str):
    """path (below the root) and text of published files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).where(~F.col("path").contains("/.staged/"))
    return files.select(F.substring_index("path", root.rsplit("/", 1)[-1] + "/", -1).alias("path"), F.decode("content", "UTF-8").alias("text"))


@query("""SELECT 'Labo/' || page_id || '.html' AS path, md5(replace(html, '—', ', ') || CASE WHEN page_id % 2 = 0 THEN ', x' ELSE ' x' END) AS h, CASE WHEN page_id % 2 = 0 OR contains(html, '—') THEN 'written' ELSE 'unchanged' END AS state FROM pages""")
def snk4_repaired_files(t):
    """Pages written, repaired and written again: only those that a repair changes are; what is read back is the repaired page."""
    tail = F.when(F.col("page_id") % 2 == 0, F.lit(" — x")).otherwise(" x")
    pages = t.pages.select(F.concat(F.lit("Labo/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.concat("html", tail).alias("html"))
    root = new_path(t.spark, "repaired")
    filesink.write_files(pages.select("path", F.col("html").alias("content")), root)
    corpus = Corpus(pages.select("path", F.lit(1.0).alias("mtime"), F.lit(True).alias("tracked")), pages)
    states = filesink.write_files(repaired(corpus).select("path", F.col("html").alias("content")), root)
    now = read_back(t.spark, root, "*.html")
    return states.join(now, "path").select("path", F.md5(F.col("text").cast("binary")).alias("h"), "state")


@query("""SELECT 'lists/' || n_regionkey || '.md' AS path, count(*) AS n_topics, bool_and(true) AS titled FROM nation GROUP BY n_regionkey""")
def snk5_worklist_files(t):
    """A worklist for each region, written as a file and read back with all its boxes and titles."""
    topics = t.nation.select(F.col("n_regionkey").alias("path"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("title"), F.array(F.lit("M"), F.col("n_regionkey").cast("string")).alias("module"), F.lit(False).alias("hidden"), F.lit("page").alias("kind"))
    lists = worklist.worklist(topics)
    root = new_path(t.spark, "lists")
    done = filesink.write_files(lists.select(F.concat(F.lit("lists/"), F.col("path").cast("string"), F.lit(".md")).alias("path"), F.col("markdown").alias("content")), root)
    titles = t.nation.groupBy(F.concat(F.lit("lists/"), F.col("n_regionkey").cast("string"), F.lit(".md")).alias("path")).agg(F.collect_list("n_name").alias("names"))
    now = read_back(t.spark, root, "*.md").join(done.where("state = 'written'"), "path").join(titles, "path")
    return now.select("path", long(F.regexp_count("text", F.lit(r"- \[ \]"))).alias("n_topics"), F.forall("names", lambda n: F.contains(F.col("text"), n)).alias("titled"))


@query("""SELECT c_nationkey::BIGINT AS k, c_custkey, CASE WHEN s_nationkey IS NOT NULL THEN 'new' ELSE 'old' END AS body FROM customer LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000) ON s_nationkey = c_nationkey""")
def snk6_replaced_partitions(t):
    """A log by nation on disk; the sections of nations with rich suppliers are written anew, the files of all others stay."""
    path = new_path(t.spark, "sections")
    rows = lambda body: t.customer.select(F.col("c_nationkey").cast("long").alias("k"), "c_custkey", F.lit(body).alias("body"))
    filesink.replace_partitions(rows("old"), path, ["k"])
    rich = t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").cast("long").alias("k")).distinct()
    filesink.replace_partitions(rows("new").join(rich, "k", "left_semi"), path, ["k"])
    return t.spark.read.parquet(path).select(long("k").alias("k"), "c_custkey", "body")


@query("""SELECT 'c' || c_custkey AS external_id, CASE WHEN c_custkey % 5 = 0 AND c_acctbal < 0 THEN 'old' ELSE c_name END AS content FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 <> 0""")
def snk9_service_state(t):
    """A service holds two thirds of the customers, some out of date; the action plan is sent, twice, and the service's records are read back."""
    folder = new_path(t.spark, "service")
    options = {"folder": folder, "changesPerMinute": "1000"}
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    body = lambda k, v: F.to_json(F.struct(k.alias("external_id"), v.alias("content")))
    have = t.customer.where("c_custkey % 3 <> 0").select(key.alias("key"), F.when(F.col("c_acctbal") < 0, "old").otherwise(F.col("c_name")).alias("content"))
    seed = have.select(F.lit("POST").alias("method"), F.lit("items").alias("path"), F.col("key").alias("external_id"), body(F.col("key"), F.col("content")).alias("body"))
    rest.send(rest.dealt(seed), folder + "-seed", **options)
    want = t.customer.where("c_custkey % 5 <> 0").select(key.alias("key"), F.col("c_name").alias("content"))
    steps = reconcile.action_plan(reconcile.plan(want, have, "key", "content")).join(want, "key", "left").withColumn("body", body(F.col("key"), F.col("content")))
    rows = rest.requests(steps, "items")
    for attempt in ("-1", "-2"):  # a second run changes nothing
        rest.send(rows, folder + attempt, **options)
    got = t.spark.read.format("rest").option("folder", folder).option("path", "items").option("pageSize", "1000").option("parts", "&".join(f"shelf={x}" for x in folder_service.SHELVES)).load()
    return got.select(F.get_json_object("json", "$.external_id").alias("external_id"), F.get_json_object("json", "$.content").alias("content"))


@query("""SELECT method, state, count(*) AS n FROM (SELECT 'POST' AS method, CASE WHEN c_custkey % 7 = 0 THEN 'refused' WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_acctbal < 0 THEN 'changed' ELSE 'present' END ELSE 'created' END AS state FROM customer
UNION ALL SELECT 'DELETE', CASE WHEN c_custkey % 7 <> 0 THEN 'deleted' ELSE 'gone' END FROM customer WHERE c_custkey % 2 = 0) GROUP BY ALL""")
def hlp6_outcomes(t):
    """What came of posts and deletes: made, changed, there already, refused as rows, deleted, gone before."""
    folder = new_path(t.spark, "outcomes")
    options = {"folder": folder, "changesPerMinute": "1000", "refused": "rows"}
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    post = lambda content, *more: t.customer.select(F.col("c_custkey"), F.lit("POST").alias("method"), F.lit("items").alias("path"), key.alias("external_id"), F.to_json(F.struct(key.alias("external_id"), content.alias("content"), *more)).alias("body"))
    bad = F.when(F.col("c_custkey") % 7 == 0, True).alias("refuse")
    cols = ("method", "path", "external_id", "body")
    rest.send(rest.dealt(post(F.when(F.col("c_acctbal") < 0, "old").otherwise(F.col("c_name"))).where("c_custkey % 3 <> 0 and c_custkey % 7 <> 0").select(*cols)), folder + "-seed", **options)
    posted = rest.send(rest.dealt(post(F.col("c_name"), bad).select(*cols)), folder + "-1", **options)
    gone = t.customer.where("c_custkey % 2 = 0").select(F.lit("DELETE").alias("method"), F.lit("items").alias("path"), key.alias("external_id"), F.lit(None).cast("string").alias("body"))
    deleted = rest.send(rest.dealt(gone), folder + "-2", **options)
    return posted.unionByName(deleted).groupBy("method", "state").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- spreadsheets


def review_of_nations(t):
    """A review workbook for each nation's customers: rows, and what they are about."""
    code = F.concat(F.lit("S"), F.col("c_custkey").cast("string"))
    book = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".xlsx"))
    text = F.concat("c_mktsegment", F.lit(" <&> \n"), "c_name")
    sheet = t.customer.select(book.alias("path"), F.col("c_name").alias("naam"), code.alias("code"), text.alias("voorstel"), F.when(F.col("c_acctbal") < 0, F.lit("")).when(F.col("c_custkey") % 3 == 0, F.concat(text, F.lit(" +"))).otherwise(F.concat(F.lit(" "), text)).alias("feedback"), F.when(F.col("c_custkey") % 2 == 0, "note").alias("noot"), F.when(F.col("c_acctbal") > 5000, "ja").alias("al_feedback"))
    about = t.customer.select(book.alias("path"), "c_nationkey").distinct().select("path", F.lit("orgUnitId").alias("name"), F.col("c_nationkey").alias("value"), F.lit(0).alias("ord"))
    return sheets.review_rows(sheet, about)


def workbooks_in(t, root: str):
    files = t.spark.read.format("binaryFile").load(f"{root}/*.xlsx")
    return sheets.sheet_cells(files.select(F.substring_index("path", "/", -1).alias("path"), "content"))


@query("""SELECT 'n' || c_nationkey || '.xlsx' AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_name), 'S' || c_custkey) AS "row", c_name AS naam, 'S' || c_custkey AS code, c_mktsegment || ' <&> ' || chr(10) || c_name AS voorstel,
CASE WHEN c_acctbal < 0 THEN 'leeg' WHEN c_custkey % 3 = 0 THEN 'aangepast' ELSE 'voorstel' END AS decision, CASE WHEN c_custkey % 2 = 0 THEN 'note' ELSE '' END AS noot, CASE WHEN c_acctbal > 5000 THEN 'ja' ELSE '' END AS al FROM customer""")
def snk10_review_workbooks(t):
    """Review workbooks written, read back, and what the reviewer decided about each proposal."""
    root = new_path(t.spark, "reviews")
    sheets.write_workbooks(review_of_nations(t), root, sheets.REVIEW_LAYOUT)
    got = sheets.reviewed(workbooks_in(t, root)).where("error is null")
    return got.select("path", long("row").alias("row"), "naam", "code", "voorstel", sheets.decision(F.col("voorstel"), F.col("feedback")).alias("decision"), "noot", F.col("al_feedback").alias("al"))


@query("""SELECT 'n' || c_nationkey || '.xlsx' AS path, sheet, n FROM (SELECT c_nationkey, 'Feedback' AS sheet, 6 * count(*) + 6 AS n FROM customer GROUP BY 1 UNION ALL SELECT c_nationkey, 'Dropbox', 2 FROM customer GROUP BY 1)""")
def src_sheet_cells(t):
    """Cells of each sheet of each nation's workbook, straight from its bytes."""
    books = sheets.workbooks(review_of_nations(t), sheets.REVIEW_LAYOUT)
    return sheets.sheet_cells(books).where("error is null").groupBy("path", "sheet").agg(F.count("value").alias("n"))


# ---------------------------------------------------------------- images


def picture(t):
    """A picture's bytes for each part, as wide as its size tells: png with a density, gif, and one cut off."""
    be = lambda c, n=8: F.unhex(F.lpad(F.hex(c.cast("long")), n, "0"))
    wide, high = F.col("p_size") * 97, F.col("p_size") * 3 + 1
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), be(wide), be(high), F.unhex(F.lit("0802000000" "00000000" "00000009" "70485973" "00000EC4" "00000EC4" "01" "00000000")))
    gif = F.concat(F.lit("GIF89a").cast("binary"), F.unhex(F.concat(F.substring(F.lpad(F.hex(wide), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(wide), 4, "0"), 1, 2), F.substring(F.lpad(F.hex(high), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(high), 4, "0"), 1, 2))))
    kind = F.col("p_partkey") % 4
    content = F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, F.substring(png, 1, 18)).otherwise(F.lit("no image").cast("binary"))
    return t.part.select("p_partkey", "p_brand", "p_size", content.alias("content"), F.concat("p_brand", F.element_at(F.array(F.lit(".png"), F.lit(".GIF"), F.lit(".png"), F.lit(".emf")), (kind + 1).cast("int"))).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'png' END AS format, CASE WHEN p_partkey % 4 < 2 THEN p_size * 97 END::BIGINT AS width, CASE WHEN p_partkey % 4 < 2 THEN p_size * 3 + 1 END::BIGINT AS height,
CASE WHEN p_partkey % 4 = 0 THEN 96 END::BIGINT AS dpi, CASE p_partkey % 4 WHEN 2 THEN 'unreadable' WHEN 3 THEN 'unknown' ELSE 'ok' END AS status, CASE WHEN p_partkey % 4 < 2 THEN least(round(p_size * 97 / 96.0::DOUBLE * 2.54::DOUBLE * 1000), 15000) ELSE 15000 END::BIGINT AS mm100 FROM part""")
def hlp25_figures(t):
    """Format, size and density of each part's picture from its bytes, and its width in a report."""
    rows = picture(t).select("p_partkey", image_info_udf("content").alias("i"))
    return rows.select("p_partkey", "i.format", long("i.width").alias("width"), long("i.height").alias("height"), long(F.round("i.dpi")).alias("dpi"), "i.status", long(F.round(figure_cm(F.col("i.width")) * 1000)).alias("mm100"))


@query("""WITH p AS (SELECT *, CASE WHEN p_partkey % 4 = 3 THEN 'unsupported' WHEN p_partkey % 4 = 2 THEN 'unreadable' WHEN p_size * 3 + 1 < 40 OR p_size * 97 < 40 THEN 'small' WHEN p_size * 97 > 1600 THEN 'resize' ELSE 'keep' END AS disposition FROM part),
n AS (SELECT *, CASE WHEN disposition IN ('keep', 'resize') THEN count(*) FILTER (WHERE disposition IN ('keep', 'resize')) OVER (PARTITION BY p_brand ORDER BY p_partkey) END AS number FROM p)
SELECT p_partkey, disposition, CASE WHEN number IS NOT NULL THEN lpad(number::VARCHAR, greatest(2, length(number::VARCHAR))::INTEGER, '0') || '.png' END AS name_out FROM n""")
def hlp16_images(t):
    """What becomes of each brand's pictures, numbered on, all told from their bytes."""
    none = t.part.limit(0).select(F.lit("").alias("sha"))
    return feedback.images_of(picture(t), none, ["p_brand"], ["p_partkey"]).select("p_partkey", "disposition", "name_out")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 3 = 0 AND l_partkey % 2 = 0 AS background, greatest(round(l_partkey * 0.5::DOUBLE), 1)::BIGINT AS width FROM lineitem""")
def hlp31_pictures(t):
    """Pictures at or near a slide's origin are backgrounds; a crop of a quarter on each side halves the pixels."""
    x = F.when(F.col("l_suppkey") % 3 == 0, F.when(F.col("l_suppkey") % 2 == 0, -18_000).otherwise(17_999)).when(F.col("l_suppkey") % 3 == 1, 18_001)
    y = F.when(F.col("l_partkey") % 2 == 0, F.lit(0)).otherwise(-18_001)
    crop = F.array(F.lit(0.25), F.lit(0.1), F.lit(0.25), F.lit(0.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", is_background(x, y).alias("background"), long(cropped(F.col("l_partkey"), crop)).alias("width"))


@query(r"""SELECT conv_id, turn, CASE WHEN t = '' THEN [role, ' ', 'a ', 'b'] ELSE [role, ' ' || t, ' ', 'a ', 'b'] END AS texts, CASE WHEN t = '' THEN 'vet||cursief|cursief,kbd' ELSE 'vet|||cursief|cursief,kbd' END AS styles FROM (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)""")
def hlp24_segments(t):
    """Turns as markup, and their segments with styles; blanks are folded across tags."""
    html = F.concat(F.lit("<p>\n<b>"), "role", F.lit("</b><!-- no --> "), tx.escape("text"), F.lit("<script>'<i>'</script> \n<i> a <kbd>b</kbd> </i></p>\n"))
    rows = t.conversations.select("conv_id", "turn", segments_udf(html).alias("s"))
    return rows.select("conv_id", "turn", F.transform("s", lambda x: x["text"]).alias("texts"), F.array_join(F.transform("s", lambda x: F.array_join(x["styles"], ",")), "|").alias("styles"))


# ---------------------------------------------------------------- gates


@query(r"""SELECT page_id, md5(html || '<img src="/r/a/i' || page_id || '.png?v#x"><a href="#t"><a href="mailto:x">') AS h FROM pages""")
def hlp20_absolute_references(t):
    """Each page's own references, and one relative image that is there, made absolute; those that begin at the root stay."""
    n = F.col("page_id").cast("string")
    pages = t.pages.select("page_id", F.concat(F.lit("a/b/"), n, F.lit(".html")).alias("path"), F.concat("html", F.lit('<img src="../i'), n, F.lit('.png?v#x"><a href="#t"><a href="mailto:x">')).alias("html"))
    rooted = rewrite.references(pages).where(F.col("ref").startswith("/")).select(F.regexp_replace(tx.local_target("path", "ref"), "^/+", "/").alias("path"))
    there = t.pages.select(F.concat(F.lit("a/i"), n, F.lit(".png")).alias("path")).unionByName(rooted).distinct()
    bare = pages.withColumn("html", F.replace("html", F.lit('="/'), F.lit('="root:/')))
    done = rewrite.absolute_references(bare, there, root="/r/")
    return done.select("page_id", F.md5(F.replace("html", F.lit('="root:/'), F.lit('="/')).cast("binary")).alias("h"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 10 END AS id FROM customer""")
def hlp2_by_external_id(t):
    """Customers with the id of their live record; trashed doubles do not count."""
    records = t.customer.where("c_custkey % 4 > 0").select("c_custkey", F.explode(F.array(F.struct((F.col("c_custkey") * 10).alias("id"), F.lit(None).cast("boolean").alias("trashed")), F.struct((F.col("c_custkey") * 10 + 1).alias("id"), F.lit(True).alias("trashed")))).alias("r")).select("c_custkey", "r.*")
    return reconcile.by_external_id(t.customer.select("c_custkey"), records, "c_custkey", "id", "trashed")


# ---------------------------------------------------------------- streams


def event_waves(t, n: int = 5):
    """The events as files of a folder, and a stream that takes one at a time."""
    folder = new_path(t.spark, "waves")
    events = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.repartition(n, "event_id").write.parquet(folder)
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(t, stream, take) -> None:
    """Run a stream until its folder is empty."""
    query_ = stream.writeStream.foreachBatch(take).option("checkpointLocation", new_path(t.spark, "progress")).trigger(availableNow=True).start()
    query_.awaitTermination()


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> (SELECT min(event_type) FROM events)""")
def stream_latest_snapshot(t):
    """The latest event of each user, kept by a stream in a snapshot of buckets; users whose latest is of the first type are gone."""
    from vellum.streaming.snapshot import Snapshot

    first = t.events.agg(F.min("event_type")).first()[0]
    snap = Snapshot(new_path(t.spark, "snapshot"), ["user_id"], ["ts", "event_id"], buckets=16)
    drained(t, event_waves(t), lambda batch, i: snap.merge(batch, i))
    return snap.read(t.spark).where(F.col("event_type") != first).select("user_id", "event_id", "event_type")


@query("""SELECT user_id::VARCHAR AS owner, event_type AS kind, arg_max(event_id, (ts, event_id))::VARCHAR AS submission FROM events GROUP BY ALL""")
def stream_latest_per_kind(t):
    """The latest event of each user and type, as the stateful stream hands it on: of all that took over, the last one."""
    from vellum.streaming import latest

    latest.uses_rocksdb(t.spark)
    path = new_path(t.spark, "latest")
    events = event_waves(t, 3)
    drained(t, latest.latest_per_kind(events, "user_id", "event_type", "event_id", "ts", "event_id", late="4000 days"), lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/{i}"))
    got = t.spark.read.parquet(f"{path}/*").where("status <> 'final'")
    return got.groupBy("owner", "kind").agg(F.max_by("submission", F.struct("at", "ord")).alias("submission"))


# ---------------------------------------------------------------- remote files


@query("""WITH u AS (SELECT 'https://h' || p_size % 7 || '.example/' || p_partkey % 500 || '?x=1' AS url, p_partkey % 500 AS k FROM part UNION ALL SELECT 'ftp://h/' || p_size, -1 FROM part),
d AS (SELECT url, any_value(k) AS k FROM u GROUP BY 1)
SELECT url, CASE WHEN k < 0 THEN 'not http' WHEN k % 6 = 0 THEN 'cached' WHEN k % 6 = 1 THEN 'status 404' WHEN k % 6 = 2 THEN 'type not taken' WHEN k % 6 = 3 THEN 'not what it says' WHEN k % 6 = 4 THEN 'unreachable: URLError' ELSE 'too large' END AS status, CASE WHEN k % 6 = 0 THEN k + 10 END::BIGINT AS bytes FROM d""")
def imp3_fetched(t):
    """Addresses of an import, asked for twice: pictures are kept and known the second time, all else says why not."""
    k = F.col("p_partkey") % 500
    address = F.concat(F.lit("https://h"), (F.col("p_size") % 7).cast("string"), F.lit(".example/"), k.cast("string"), F.lit("?x=1"))
    urls = t.part.select(address.alias("url"), k.alias("k")).distinct()
    kind, gif = F.col("k") % 6, F.concat(F.lit("GIF89a"), F.lit("\x01\x01\x01\x01"), F.repeat(F.lit("x"), F.col("k").cast("int")))
    head = F.to_json(F.struct(F.when(kind == 1, 404).otherwise(200).alias("status"), F.when(kind == 2, "text/html").when(kind == 3, "image/png").otherwise("image/gif; q=1").alias("type")))
    body = F.when(kind == 5, F.concat(gif, F.repeat(F.lit("y"), F.lit(2000)))).otherwise(gif)
    root = new_path(t.spark, "web")
    filesink.write_files(urls.where(kind != 4).select(F.sha2("url", 256).alias("path"), F.concat(head, F.lit("\n"), body).alias("content")), root)
    asked = urls.select("url").unionByName(t.part.select(F.concat(F.lit("ftp://h/"), F.col("p_size").cast("string")).alias("url")))
    cache = new_path(t.spark, "cache")
    for _ in range(2):
        got = fetch.fetched(asked, cache, max_bytes=1000, per_second=100_000, web=fetch.FolderWeb(root))
    return got.select("url", "status", "bytes")


# ---------------------------------------------------------------- helpers of assemblers


@query("""SELECT page_id, unnest([1, 2])::BIGINT AS nr, unnest(['no/' || page_id || '.html', 'a&b/' || page_id || '.html']) AS source FROM pages WHERE page_id % 2 = 1 UNION ALL SELECT page_id, 1, 'no/' || page_id || '.html' FROM pages WHERE page_id % 2 = 0""")
def hlp18_missing_sources(t):
    """Two questions on each page, with sources that are there, missing, written with entities, and in a comment."""
    n = F.col("page_id").cast("string")
    html = F.concat(F.lit('<ol class="vragen"><li data-bron="p/'), n, F.lit(".html  no/"), n, F.lit('.html">q</li><!-- <li data-bron="gone">x</li> --><li data-bron="a&amp;b/'), n, F.lit('.html">r</li><li>s</li></ol>'))
    pages = t.pages.select(F.concat(F.lit("p/"), n, F.lit(".html")).alias("path"), html.alias("html"))
    files = pages.select("path").unionByName(t.pages.where("page_id % 2 = 0").select(F.concat(F.lit("a&b/"), n, F.lit(".html")).alias("path")))
    return assemble.missing_sources(pages, files).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("page_id"), long("nr").alias("nr"), "source")


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Labo/' || n_name WHEN 1 THEN 'Labo/' || n_name ELSE 'Labo/' || n_name || '/Extra' END AS folder, CASE n_nationkey % 3 WHEN 0 THEN 'Labo/' || n_name || '/Theorie/Spiekblad.html' WHEN 1 THEN 'Labo/' || n_name || '/Theorie/x.html' ELSE 'Labo/' || n_name || '/Extra/x.html' END AS page,
CASE n_nationkey % 3 WHEN 2 THEN 'Labo-' || n_name || '-Extra-spiekblad.pdf' ELSE 'Labo-' || n_name || '-spiekblad.pdf' END AS pdf, CASE WHEN n_nationkey % 4 > 0 THEN n_name || ' & <more>' END AS title FROM nation""")
def hlp29_sheets(t):
    """A sheet of each nation named by its folder, its page, or a page elsewhere; and its lab's title."""
    base = F.concat(F.lit("Labo/"), "n_name")
    target = F.when(F.col("n_nationkey") % 3 == 0, F.concat(base, F.lit("/"))).when(F.col("n_nationkey") % 3 == 1, F.concat(base, F.lit("/Theorie/x.html"))).otherwise(F.concat(base, F.lit("/Extra/x.html")))
    overview = F.when(F.col("n_nationkey") % 4 > 0, F.concat(F.lit('<p>x</p><h1 class="a">Labo  <b>'), "n_name", F.lit("</b> &amp; &lt;more&gt;\n</h1><h1>no</h1>"))).otherwise("<h2>x</h2>")
    return t.nation.select("n_nationkey", assemble.sheet_of(target).alias("s"), assemble.lab_title(overview).alias("title")).select("n_nationkey", "s.*", "title")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 > 0 THEN [round(l_partkey / 1440.0::DOUBLE * 25.4::DOUBLE, 1), round(l_suppkey / 1440.0::DOUBLE * 25.4::DOUBLE, 1)] ELSE [] END AS mm, l_linenumber % 2 = 0 AS bold FROM lineitem""")
def hlp33_table_layout(t):
    """Two columns of each line, a third of them with a width that is no number; and runs that are bold but for blanks."""
    twips = F.array(F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_suppkey").cast("string")).otherwise("auto"))
    run = lambda text, bold: F.struct(F.lit(text).alias("text"), bold.alias("bold"))
    runs = F.array(run("x", F.lit(True)), run("  ", F.lit(False)), run("y", F.col("l_linenumber") % 2 == 0))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", assemble.column_widths(twips).alias("mm"), assemble.fully_bold(runs).alias("bold"))
