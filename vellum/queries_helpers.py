"""Queries of importers, sinks and helpers that the other query modules leave."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.corpus import Corpus
from vellum.functions import kernels
from vellum.functions import text as tx
from vellum.functions.tokens import TEXTS
from vellum.operators import answers, assemble, feedback, menu, privacy, reconcile, rewrite, sequence, worklist
from vellum.plans import runner
from vellum.queries import long, query
from vellum.queries_more import LINES_SQL, QUESTIONS_SQL, docx_udf, line_questions, nation_menus, page_corpus, pptx_udf

# ---------------------------------------------------------------- sources


@query("SELECT r_name AS path, r_regionkey % 2 = 1 AS broken FROM region")
def src6_broken_menus(t):
    """Menus of which every other is cut short; a broken one is an error row, not an exception."""
    docs = nation_menus(t).join(t.region, F.col("path") == F.col("r_name")).select("path", F.when(F.col("r_regionkey") % 2 == 1, F.expr("substring(doc, 1, length(doc) - 3)")).otherwise(F.col("doc")).alias("doc"))
    return menu.flatten(docs).select("path", F.col("error").isNotNull().alias("broken"))


@query("SELECT 'r' || n_regionkey AS module, n_name AS name, n_nationkey::BIGINT AS nr FROM nation")
def src7_manifest(t):
    """A manifest with a module for each region, scanned."""
    from vellum.sources.literals import manifest_modules

    topic = F.concat(F.lit("{ id: '"), F.col("n_nationkey").cast("string"), F.lit("', name: '"), "n_name", F.lit("', href: 'x' },"))
    mods = t.nation.withColumn("topic", topic).groupBy("n_regionkey").agg(sequence.text_in_order("topic", ["n_nationkey"]).alias("ts")).select(F.col("n_regionkey").alias("o"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(": { categories: [{ name: 'c', topics: ["), "ts", F.lit("] }] },")).alias("m"))
    text = mods.agg(F.concat(F.lit("window.R = { "), sequence.text_in_order("m", ["o"]), F.lit(" };")).alias("js"))
    flat = kernels.vectorised(lambda js: [{"module": m["module"], "name": x["name"], "nr": x["id"]} for m in manifest_modules(js) for x in m["topics"]], "array<struct<module:string,name:string,nr:string>>")
    return text.select(F.explode(flat("js")).alias("x")).select("x.module", "x.name", F.col("x.nr").cast("long").alias("nr"))


@query("SELECT c_custkey, 'C' || c_custkey AS code, c_name AS name FROM customer")
def src11_dropboxes(t):
    from vellum.sources.package import dropboxes_udf

    box = F.concat(F.lit("<folder name='"), "c_name", F.lit("' resource_code='C"), F.col("c_custkey").cast("string"), F.lit("'/>"))
    files = t.customer.withColumn("box", box).groupBy("c_nationkey").agg(F.concat(F.lit("<d>"), sequence.text_in_order("box", ["c_custkey"]), F.lit("</d>")).alias("xml"))
    rows = files.select(F.explode(dropboxes_udf("xml")).alias("x")).select("x.code", "x.name")
    return rows.withColumn("c_custkey", F.regexp_extract("code", r"\d+", 0).cast("long"))


@query("SELECT n_regionkey, n_nationkey || '.html' AS zip_path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey || '.html') AS ord FROM nation")
def src12_without_manifest(t):
    from vellum.sources.files import unzip
    from vellum.sources.package import topics

    names = F.array_sort(F.collect_list(F.concat(F.col("n_nationkey").cast("string"), F.lit(".html"))))
    packed = t.nation.groupBy("n_regionkey").agg(names.alias("ns")).select("n_regionkey", assemble.zip_udf("ns", "ns").alias("content"))
    return topics(unzip(packed, "n_regionkey"), "n_regionkey").select("n_regionkey", "zip_path", long("ord").alias("ord"))


@query("SELECT conv_id AS student_id, turn, role || turn || '.txt' AS name FROM conversations")
def src16_submissions(t):
    """Turns as submitted files, those of the user packed with junk beside them; all come out once."""
    from vellum.sources.files import expand_submissions

    name = F.concat("role", F.col("turn").cast("string"), F.lit(".txt"))
    files = t.conversations.select(F.col("conv_id").alias("student_id"), "turn", "role", name.alias("name"), F.col("text").cast("binary").alias("content"))
    plain = files.where("role <> 'user'")
    packed = files.where("role = 'user'").select("student_id", "turn", F.lit("s.zip").alias("name"), assemble.zip_udf(F.array(F.col("name"), F.lit("__MACOSX/x"), F.lit("~$y.docx")), F.array(F.col("content"), F.lit(b"a"), F.lit(b"b"))).alias("content"))
    return expand_submissions(plain.select(*packed.columns).unionByName(packed), keys=("student_id", "turn")).select("student_id", "turn", "name")


@query("SELECT c_name AS naam, c_custkey AS code FROM customer")
def src17_checked_header(t):
    return feedback.with_header(t.customer.select(F.col("c_name").alias("naam"), F.col("c_custkey").alias("code")), ["naam", "code"])


@query("SELECT page_id, 'verslag ' || page_id AS block FROM pages")
def src20_report_blocks(t):
    pages = t.pages.select(F.col("page_id").cast("string").alias("path"), F.concat("html", F.lit("<!-- verslag "), F.col("page_id").cast("string"), F.lit(" -->")).alias("html"))
    return worklist.report_blocks_of(pages).select(F.col("path").cast("long").alias("page_id"), tx.squeeze("block").alias("block"))


# ---------------------------------------------------------------- sinks and filters


@query("SELECT coalesce(n.s_nationkey, c.c_nationkey) AS k, CASE WHEN n.s_nationkey IS NOT NULL THEN 'new' ELSE 'old' END AS body FROM (SELECT DISTINCT c_nationkey FROM customer) c FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000) n ON s_nationkey = c_nationkey")
def snk6_replaced_sections(t):
    old = t.customer.select(F.col("c_nationkey").alias("k"), F.lit("old").alias("body")).distinct()
    new = t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.lit("new").alias("body")).distinct()
    return rewrite.replace_section(old, new, "k", "body")


@query("SELECT conv_id::VARCHAR AS code, '| ' || conv_id || ' | 0 | 0 | 0 | new |' AS line FROM (SELECT DISTINCT conv_id FROM conversations)")
def snk12_overview(t):
    parts = t.conversations.select(F.col("conv_id").cast("string").alias("code"), F.col("turn").alias("place"), F.lit("docx").alias("kind"), F.lit("n").alias("name"), "text", F.lit(0).alias("n_images"))
    reports = feedback.reports(parts, privacy.name_patterns(["Nobody Known"]), ["x"])
    return feedback.overview(reports, reports.select("code", F.lit("new").alias("status")), 1).select("code", "line")


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def flt1_excluded_folders(t):
    """Pages laid in a staging folder, a hidden one or a site folder; only the last are pages of the corpus."""
    n = F.col("page_id")
    where = F.concat(F.when(n % 3 == 0, "_incoming/x/").otherwise("Labo/"), n.cast("string"), F.lit(".html"))
    texts = t.pages.select(where.alias("path"), "html")
    c = Corpus(texts.select("path", F.lit(1.0).alias("mtime"), F.lit(True).alias("tracked")), texts)
    return c.pages.select(F.regexp_extract("path", r"(\d+)\.html", 1).cast("long").alias("page_id"))


@query("SELECT count(*) - 1 AS n FROM pages")
def flt2_skipped_pages(t):
    first = t.pages.agg(F.min("page_id")).first()[0]  # one name for the configuration
    return page_corpus(t, "Labo/%s.html", "", {"check": {"skip_pages": [f"{first}.html"]}}).checked.agg(F.count("*").alias("n"))


@query("SELECT n_nationkey FROM nation WHERE lower(n_name) LIKE '%an%' OR n_regionkey = 3")
def flt7_only(t):
    from vellum.sources.package import only

    topics = t.nation.select("n_nationkey", F.array(F.when(F.col("n_regionkey") == 3, "Region Three").otherwise("Other")).alias("module"), F.col("n_name").alias("title"))
    return only(topics, ["AN", "three"]).select("n_nationkey")


# ---------------------------------------------------------------- extraction


@query(f"SELECT doc_id, 1::BIGINT AS list_no, 1::BIGINT AS begin, count(*) AS n FROM ({QUESTIONS_SQL}) GROUP BY 1")
def ext8_question_lists(t):
    rows = line_questions(t).select("path", F.explode(kernels.question_lists_udf("html")).alias("l")).where(F.size("l.items") > 0)
    return rows.select(F.col("path").cast("long").alias("doc_id"), long("l.list_no").alias("list_no"), long("l.begin").alias("begin"), long(F.size("l.items")).alias("n"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM documents")
def ext14_plain_text(t):
    return t.documents.select("doc_id", assemble.plain_text(F.concat(F.lit("<p>"), tx.escape("text"), F.lit("</p>"))).alias("plain"))


@query("SELECT page_id, unnest([7 + page_id % 2, 2, page_id + 100]) AS number FROM pages")
def ext17_slide_numbers(t):
    """A deck of each page: a numbered slide, one without number, which has its place, and one whose number stands within it."""
    first = F.concat(F.lit('<section class="slide" data-slide="'), (F.col("page_id") % 2 + 7).cast("string"), F.lit('">x</section>'))
    last = F.concat(F.lit('<section class="slide"><div data-slide="'), (F.col("page_id") + 100).cast("string"), F.lit('">'), "page_id", F.lit("</div></section>"))
    deck = t.pages.select(F.col("page_id").alias("path"), F.concat(first, F.lit('<section class="slide" data-nr="9">y</section>'), last).alias("html"))
    return assemble.slides(deck).select(F.col("path").alias("page_id"), long("number").alias("number"))


@query("SELECT page_id, 'Theorie/' || page_id || '.html' AS target FROM pages")
def ext20_answer_links(t):
    pages = t.pages.select(F.concat(F.lit("Labo/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.concat(F.lit('<ol class="vragen"><li>q<div class="oplossing">see <a href="../Theorie/'), F.col("page_id").cast("string"), F.lit('.html#x">t</a></div></li></ol>')).alias("html"))
    rows = assemble.question_rows(pages).select("path", F.explode(tx.every("answer", r'href="([^"]+)"')).alias("href"))
    return rows.select(F.regexp_extract("path", r"(\d+)\.html", 1).cast("long").alias("page_id"), tx.local_target("path", "href").alias("target"))


@query(f"SELECT doc_id, nr, 1::BIGINT AS n_runs FROM ({LINES_SQL}) WHERE text <> ''")
def ext23_merged_runs(t):
    """Neighbouring runs of one format come out as one."""
    from vellum.sources.office import read_docx

    blocks = read_docx(t.documents.select("doc_id", docx_udf("text").alias("content")), "doc_id").where("kind = 'paragraph'")
    return blocks.where(F.size("runs") > 0).select("doc_id", long(F.col("ord") + 1).alias("nr"), long(F.size("runs")).alias("n_runs"))


@query("SELECT l_orderkey, c AS col FROM (SELECT l_orderkey, unnest([0, 1, 2]) AS c FROM (SELECT DISTINCT l_orderkey FROM lineitem)) WHERE c = 2")
def ext25_empty_columns(t):
    """Lines of an order as table rows whose third column is blank."""
    cells = t.lineitem.select("l_orderkey", F.posexplode(F.array(F.col("l_returnflag"), F.col("l_linestatus"), F.lit(" "))).alias("col", "text"))
    return assemble.empty_columns(cells, ["l_orderkey"])


@query("SELECT n_regionkey, 'QR code' AS title FROM nation GROUP BY 1")
def j23_titles_of_codes(t):
    from vellum.plans.rules.menu import expected_title

    boxes = t.nation.select("n_regionkey", F.lit("assignment").alias("kind"), F.lit(None).cast("string").alias("part")).distinct()
    return boxes.select("n_regionkey", expected_title(F.col("kind"), F.col("part")).alias("title"))


@query("SELECT 'Labo/' || page_id || '.html' AS pad, page_id % 2 = 1 AS untracked FROM pages")
def j1c_untracked(t):
    """Each page links to a file of its own; every other file is not under version control."""
    n = F.col("page_id")
    texts = t.pages.select(F.concat(F.lit("Labo/"), n.cast("string"), F.lit(".html")).alias("path"), F.concat(F.lit('<a href="f'), n.cast("string"), F.lit('.bin">')).alias("html"))
    data = t.pages.select(F.concat(F.lit("Labo/f"), n.cast("string"), F.lit(".bin")).alias("path"), (n % 2 == 0).alias("tracked"))
    files = texts.select("path", F.lit(True).alias("tracked")).unionByName(data).withColumn("mtime", F.lit(1.0))
    found = runner.findings(Corpus(files, texts), only=["links"]).select("pad", F.lit(True).alias("bad"))
    return texts.select(F.col("path").alias("pad")).join(found, "pad", "left").select("pad", F.coalesce("bad", F.lit(False)).alias("untracked"))


# ---------------------------------------------------------------- aggregates, order, sets


@query("SELECT count(*) FILTER (WHERE c_custkey % 2 = 0) AS n_even, 0::BIGINT AS n_other FROM customer")
def agg14_names_replaced(t):
    _, n = privacy.redacted(F.when(F.col("c_custkey") % 2 == 0, "by Peeters.").otherwise("by peeter_s"), privacy.name_patterns(["Jan Peeters"]))
    return t.customer.withColumn("n", n).agg(F.sum(F.when(F.col("c_custkey") % 2 == 0, F.col("n"))).alias("n_even"), F.sum(F.when(F.col("c_custkey") % 2 == 1, F.col("n"))).alias("n_other"))


@query("SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY lower(n_name)) AS place FROM nation")
def srt2_by_lower_name(t):
    return t.nation.select("n_regionkey", "n_name", long(F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.lower("n_name")))).alias("place"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) AS place FROM orders")
def srt6_cover_first(t):
    parts = t.orders.withColumn("cover", F.col("o_orderstatus") == "F")
    return feedback.report_order(parts, ["o_custkey"], "cover", ["o_orderkey"]).select("o_custkey", "o_orderkey", long("place").alias("place"))


@query("SELECT regel, count(*) * k AS n FROM pages, (VALUES ('theme-wiring', 2), ('platform-hotlink', 1)) v(regel, k) GROUP BY regel, k")
def set6_rules_in_order(t):
    found = runner.findings(page_corpus(t, "Labo/%s.html", "content/enforced"), only=["theme-wiring", "platform-hotlink"])
    return found.groupBy("regel").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE WHEN regexp_matches(s_name, '^[A-Za-z]') THEN '' ELSE 'q-' END || regexp_replace(s_name, '[^A-Za-z0-9_-]', '-', 'g') AS id, 'q-' || s_suppkey AS q FROM supplier")
def str5_identifiers(t):
    return t.supplier.select("s_suppkey", tx.identifier("s_name").alias("id"), tx.identifier(F.col("s_suppkey").cast("string")).alias("q"))


@query("SELECT doc_id, source || '.TXT' AS name, source AS stem, '.txt' AS ext FROM documents")
def pth5_name_parts(t):
    p = F.concat(F.lit("x/"), "source", F.lit(".TXT"))
    return t.documents.select("doc_id", tx.basename(p).alias("name"), tx.stem(p).alias("stem"), tx.extension(p).alias("ext"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS ok FROM customer")
def xml1_well_formed(t):
    x = F.concat(F.lit("<a>"), "c_name", F.when(F.col("c_custkey") % 2 == 0, "</a>").otherwise("</b>"))
    return t.customer.select("c_custkey", (kernels.well_formed_udf(x) == "").alias("ok"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def arr1_pairs(t):
    """Pairs within a region; a region's nations are few by definition."""
    x, y = t.nation.alias("x"), t.nation.alias("y")
    return x.join(y, (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_nationkey") < F.col("y.n_nationkey"))).select(F.col("x.n_nationkey").alias("a"), F.col("y.n_nationkey").alias("b"))


@query("SELECT n_nationkey, 'test' AS kind FROM nation")
def arr3_name_series(t):
    """Tests of two modules, named in the order of the menu."""
    names = [r["n_name"] for r in t.nation.orderBy("n_nationkey").collect()]  # one row for each module
    parse = kernels.name_parser(names)
    last, other = F.lit(names[-1]), F.lit(names[-2])
    text = F.concat(F.lit("Test labo "), F.when(F.col("n_name") == last, F.concat(other, F.lit(" en "), last)).otherwise(F.concat("n_name", F.lit(" en "), last)), F.lit(" (!)"))
    return t.nation.select("n_nationkey", parse(text, "n_name").alias("p")).select("n_nationkey", "p.kind")


# ---------------------------------------------------------------- plans, imports, exports


@query("SELECT p_partkey, p_brand || '#' || p_partkey || '@' || left(sha1(p_name), 10) AS external_id FROM part")
def rcn2_external_ids(t):
    h = privacy.item_hash(F.col("p_name"), F.expr("cast(array() as array<binary>)"))
    return t.part.select("p_partkey", F.concat("p_brand", F.lit("#"), F.col("p_partkey").cast("string"), F.lit("@"), h).alias("external_id"))


@query("""SELECT l_orderkey, CASE l_orderkey % 5 WHEN 0 THEN 'flag' WHEN 1 THEN 'bold' WHEN 2 THEN 'no signal' WHEN 3 THEN 'one column' ELSE CASE WHEN n > 2 THEN 'style' ELSE 'no signal' END END AS reason,
l_orderkey % 5 < 2 OR (l_orderkey % 5 = 4 AND n > 2) AS is_header FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def imp5_header_reason(t):
    """Lines of an order as a table: marked, bold in its first row (and in others, and with an empty cell), plain, of one column, or styled."""
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    kind = F.col("l_orderkey") % 5
    cells = F.explode(F.when(kind == 3, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("col")
    rows = t.lineitem.withColumn("row", F.row_number().over(w) - 1).select("l_orderkey", "row", cells)
    text = F.when((kind == 1) & (F.col("col") == 1), "").otherwise("x")
    cells = rows.select("*", ((kind == 1) & (F.col("col") == 0)).alias("all_bold"), ((kind == 0) & (F.col("row") == 0)).alias("header"), text.alias("text"))
    return assemble.header_reason(cells, ["l_orderkey"], F.col("l_orderkey") % 5 > 2)


@query(f"SELECT doc_id, 0::BIGINT AS chapters, count(*) AS n FROM ({LINES_SQL}) GROUP BY 1")
def imp6_sections(t):
    """Documents without headings are one section before any chapter."""
    from vellum.sources.office import read_docx

    blocks = read_docx(t.documents.select("doc_id", docx_udf("text").alias("content")), "doc_id")
    return assemble.docx_sections(blocks, "doc_id").groupBy("doc_id").agg(long(F.max("chapter_no")).alias("chapters"), F.count("*").alias("n"))


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS slide, '<section class=\"slide content\"><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p></section>' AS html FROM ({LINES_SQL}) WHERE trim(text) <> ''")
def imp7_slide_sections(t):
    from vellum.sources.office import read_pptx

    shapes = read_pptx(t.documents.select("doc_id", pptx_udf("text").alias("content")), "doc_id").where("slide is not null")
    return assemble.slide_html(shapes, "doc_id").select("doc_id", long("slide").alias("slide"), "html")


@query("SELECT conv_id::VARCHAR AS code, string_agg('## n' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def exp9_reports(t):
    parts = t.conversations.select(F.col("conv_id").cast("string").alias("code"), F.col("turn").alias("place"), F.lit("docx").alias("kind"), F.lit("n").alias("name"), "text", F.lit(0).alias("n_images"))
    return feedback.reports(parts, privacy.name_patterns(["Nobody Known"]), ["x"]).select("code", "text")


@query("SELECT conv_id, chapter_no, count(*) AS n FROM (SELECT conv_id, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS chapter_no FROM conversations) GROUP BY ALL")
def exp3_chapters(t):
    out = sequence.chapter_numbers(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user", F.lit(True))
    return out.groupBy("conv_id", long(F.coalesce("chapter_no", F.lit(0))).alias("chapter_no")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'a' ELSE 'b' END AS kind, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nr FROM customer")
def hlp34_continued_numbers(t):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "a").otherwise("b").alias("kind"), long(F.row_number().over(w)).alias("nr"))


@query("SELECT c_custkey, c_custkey::VARCHAR AS name, CASE WHEN c_acctbal > 0 THEN NULL ELSE 'answers nothing' END AS problem FROM customer")
def hlp22_leftovers(t):
    name = F.col("c_custkey").cast("string").alias("name")
    got = answers.match_answers(t.customer.where("c_acctbal > 0").select(name), t.customer.select(name, F.lit("x").alias("body")), ["name"])
    return got.select(F.col("name").cast("long").alias("c_custkey"), "name", "problem")


@query("SELECT c_custkey, 'figure' AS kind, '2' AS page FROM customer")
def hlp23_answer_parts(t):
    body = F.concat(F.lit("text\n![f"), F.col("c_custkey").cast("string"), F.lit(".pdf]{page=2}\n```\ncode\n```"))
    got = answers.answer_parts(t.customer.select("c_custkey", body.alias("body")), ["c_custkey"]).where("kind = 'figure'")
    return got.select("c_custkey", "kind", F.element_at("options", F.lit("page")).alias("page"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, least(l_partkey, ceil(l_quantity / 25.4 * 150))::BIGINT AS px FROM lineitem")
def hlp21_image_budget(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", long(tx.target_pixels(F.col("l_partkey").cast("int"), F.col("l_quantity"), 150)).alias("px"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) AS n, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'Theory' WHEN count(*) FILTER (WHERE o_orderstatus <> 'F') = 0 THEN 'Exercises' ELSE 'Theory and exercises' END AS subtitle FROM orders GROUP BY 1")
def hlp27_subtitles(t):
    f = F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy("o_custkey").agg(f.alias("n_f"), F.count("*").alias("n")).select("*", assemble.subtitle(F.col("n_f"), F.col("n") - F.col("n_f"), False).alias("subtitle"))


@query(f"SELECT page_id, '{TEXTS.interactive}<p id=\"' || page_id || '-html-a\">' || page_id || '</p>' AS fragment FROM pages")
def hlp28_page_transform(t):
    n = F.col("page_id").cast("string")
    pages = t.pages.select(F.concat(n, F.lit(".html")).alias("path"), F.concat(F.lit('<body><script>x</script><p id="a">'), n, F.lit('</p><div class="solution-container">s</div></body>')).alias("html"))
    return assemble.page_transform(pages, keep_solutions=False).select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("page_id"), "fragment")


@query("SELECT doc_id, text FROM documents")
def hlp15_decode_basic(t):
    return t.documents.select("doc_id", tx.decode_basic(tx.escape("text", True)).alias("text"))


@query("SELECT n_nationkey, 'Test ' || n_name AS name, 'n-' || n_nationkey AS id, reconcile AS action FROM nation, (SELECT 'keep' AS reconcile)")
def hlp3_derived_names(t):
    return t.nation.select("n_nationkey", F.concat(F.lit("Test "), "n_name").alias("name"), F.concat_ws("-", F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), reconcile.content_plan(F.lit(1), F.lit(1), F.lit(True)).alias("action"))
