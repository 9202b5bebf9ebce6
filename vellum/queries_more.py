"""Further queries: rules over pages, documents of other formats, rewrites, plans and streams."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.corpus import Corpus, merge
from vellum.conf import DEFAULTS
from vellum.functions import kernels
from vellum.functions import text as tx
from vellum.operators import answers, assemble, menu, privacy, reconcile, rewrite, sequence
from vellum.plans import runner
from vellum.queries import ORACLE, QUERIES, Tables, links, long, query

# ---------------------------------------------------------------- rules on the pages table

def page_corpus(t: Tables, place: str, more="", conf: dict | None = None) -> Corpus:
    """All pages, whole, each at a path of its own with something (a text or a column) appended."""
    head, _, tail = place.partition("%s")
    more = F.lit(more) if isinstance(more, str) else more
    texts = t.pages.select(F.concat(F.lit(head), F.col("page_id").cast("string"), F.lit(tail)).alias("path"), F.concat("html", more).alias("html"))
    files = texts.select("path", F.lit(1.0).alias("mtime"), F.lit(True).alias("tracked"))
    return Corpus(files, texts, merge(DEFAULTS, conf or {}))


@query("""SELECT 'Labo/' || page_id || '.html' AS pad, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)\\s*=\\s*"([^"]+)"', 1)) AS href FROM pages) WHERE href LIKE '/%' AND href NOT LIKE '//%'""")
def rule_links(t):
    found = runner.findings(page_corpus(t, "Labo/%s.html"), only=["links"])
    return found.select("pad", F.regexp_replace("boodschap", "^leads nowhere: ", "").alias("href"))


@query(r"""SELECT 'fout' AS ernst, 'theme-wiring' AS regel, 2 * count(*) AS n FROM pages UNION ALL SELECT 'fout', 'platform-hotlink', count(*) FROM pages UNION ALL
SELECT 'fout', 'links', count(*) FROM (SELECT unnest(regexp_extract_all(html, '(?:href|src)\s*=\s*"([^"]+)"', 1)) AS href FROM pages) WHERE href LIKE '/%' AND href NOT LIKE '//%' HAVING count(*) > 0""")
def findings_pages(t):
    """All standard rules in one run."""
    found = runner.findings(page_corpus(t, "Labo/%s.html", "/content/enforced/1"), ("standard",))
    return found.groupBy("ernst", "regel").agg(F.count("*").alias("n"))


@query("SELECT 2 * count(*) AS fouten, 0::BIGINT AS waarschuwingen, 0::BIGINT AS adviezen, 0::BIGINT AS afwijkingen FROM pages")
def agg1_severity_counts(t):
    from vellum.plans.report import counts

    return counts(runner.findings(page_corpus(t, "Labo/%s.html"), only=["theme-wiring"]))


@query("""SELECT 'Labo/' || page_id || '.html' AS pad FROM pages""")
def snk2_json_findings(t):
    from vellum.plans.report import json_rows

    return json_rows(runner.findings(page_corpus(t, "Labo/%s.html", "—"), only=["em-dash"])).select(F.get_json_object("finding", "$.pad").alias("pad"))


@query("SELECT 'Labo/' || page_id || '.html' AS path, replace(html, '—', ', ') || ', x' || chr(10) AS html FROM pages")
def fix1_repaired_pages(t):
    """Every page with a dash and a retired include appended, repaired."""
    from vellum.operators.repair import repaired

    done = repaired(page_corpus(t, "Labo/%s.html", ' — x\n<script src="a/oplossingen.js"></script>\n'))
    return done.select("path", "html")


@query("""SELECT page_id, '<pre class="code-wrapper language-c"><code>int a = ' || page_id || ';' || chr(10) || 'if (a)' || chr(10) || '{' || chr(10) || 'b = a == 1 && c;' || chr(10) || '</code></pre>' AS html FROM pages""")
def fix2_code_blocks(t):
    """A code block with a tight operator and a trailing brace for every page, repaired."""
    from vellum.operators.repair import repaired

    code = F.concat(F.lit('<pre class="code-wrapper language-c"><code>int a='), F.col("page_id").cast("string"), F.lit(";\nif(a) {\nb=a==1&&c;\n</code></pre>"))
    texts = t.pages.select(F.concat(F.lit("Labo/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), code.alias("html"))
    c = Corpus(texts.select("path", F.lit(1.0).alias("mtime"), F.lit(True).alias("tracked")), texts)
    return repaired(c).select(F.regexp_extract("path", r"(\d+)\.html", 1).cast("long").alias("page_id"), "html")


@query("""SELECT page_id, '<iframe src="https://www.youtube.com/embed/' || page_id || '" referrerpolicy="strict-origin-when-cross-origin" allowfullscreen></iframe>' AS html FROM pages""")
def fix4_policies(t):
    from vellum.operators.repair import with_policy

    frame = F.concat(F.lit('<iframe src="https://www.youtube.com/embed/'), F.col("page_id").cast("string"), F.lit('" allowfullscreen></iframe>'))
    return t.pages.select("page_id", with_policy(frame).alias("html"))


@query("SELECT DISTINCT target AS path FROM (SELECT substr(href, 2) AS target FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) WHERE regexp_full_match(href, '/[a-z]+'))")
def fix6_to_stage(t):
    """Link targets that exist and are not tracked; links are made relative first."""
    from vellum.operators.repair import to_stage

    texts = t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.regexp_replace("html", 'href="/', 'href="').alias("html"))
    hrefs = links(t).where(F.col("href").rlike("^/[a-z]+$")).select(F.substring("href", 2, 999).alias("path")).distinct()
    files = texts.select("path", F.lit(True).alias("tracked")).unionByName(hrefs.select("path", F.lit(False).alias("tracked"))).withColumn("mtime", F.lit(1.0))
    return to_stage(Corpus(files, texts))


# ---------------------------------------------------------------- menus


def nation_menus(t: Tables) -> DataFrame:
    """A menu document for each region: a module with a topic for each nation."""
    items = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.concat(F.lower("n_name"), F.lit(".html")).alias("page")).alias("item"))))
    mods = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.transform(items, lambda x: x["item"]).alias("items"))
    module = F.struct(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.concat(F.lit("1. "), "r_name").alias("title"), F.col("r_name").alias("name"), (F.col("r_regionkey") == 0).alias("hidden"), "items")
    return mods.select(F.col("r_name").alias("path"), F.to_json(F.struct(F.array(module).alias("modules"))).alias("doc"))


@query("""SELECT r_name AS path, lower(n_name) || '.html' AS target, '1. ' || r_name AS module, r_name AS name, r_regionkey = 0 AS hidden, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS nth FROM nation JOIN region ON n_regionkey = r_regionkey""")
def jsn2_menu_targets(t):
    rows = menu.rows(menu.flatten(nation_menus(t))).where("kind = 'page'")
    return rows.select("path", "target", menu.category_path().alias("module"), "name", "hidden", long(F.row_number().over(Window.partitionBy("path").orderBy("ord"))).alias("nth"))


@query("SELECT r_name AS path, r_name AS menu_path, lower(n_name) || '.html' AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def jsn3_menu_paths(t):
    rows = menu.rows(menu.flatten(nation_menus(t))).where("kind = 'page'")
    return rows.select("path", F.array_join(menu.menu_path(), "/").alias("menu_path"), "target")


@query("SELECT r_name AS path, 'n' || n_nationkey AS value FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'r' || r_regionkey FROM region")
def jsn2_menu_ids(t):
    return menu.repeated_ids(menu.flatten(nation_menus(t))).where("not repeat").select("path", "value")


# ---------------------------------------------------------------- other formats


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def _esc(s: str) -> str:
    return "".join(c for c in s if c >= " ").replace("&", "&amp;").replace("<", "&lt;")


def _docx(text: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t xml:space='preserve'>{_esc(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    return _zip({"word/document.xml": f"<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body>{body}</w:body></w:document>"})


def _pptx(text: str) -> bytes:
    ns = "xmlns:p='http://schemas.openxmlformats.org/presentationml/2006/main' xmlns:a='http://schemas.openxmlformats.org/drawingml/2006/main' xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'"
    lines = [x for x in text.split("\n") if x.strip()]
    parts = {"ppt/presentation.xml": f"<p:presentation {ns}><p:sldIdLst>" + "".join(f"<p:sldId r:id='r{i}'/>" for i in range(len(lines))) + "</p:sldIdLst></p:presentation>"}
    parts["ppt/_rels/presentation.xml.rels"] = "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>" + "".join(f"<Relationship Id='r{i}' Type='x/slide' Target='slides/s{i}.xml'/>" for i in range(len(lines))) + "</Relationships>"
    for i, x in enumerate(lines):
        parts[f"ppt/slides/s{i}.xml"] = f"<p:sld {ns}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{_esc(x)}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
    return _zip(parts)


docx_udf, pptx_udf = kernels.vectorised(_docx, "binary"), kernels.vectorised(_pptx, "binary")
LINES_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS nr FROM documents"


@query(LINES_SQL)
def src13_docx_blocks(t):
    """Documents packed as word files and read back as paragraphs."""
    from vellum.sources.office import read_docx

    files = t.documents.select("doc_id", docx_udf("text").alias("content"))
    return read_docx(files, "doc_id").where("kind = 'paragraph'").select("doc_id", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("text"), long(F.col("ord") + 1).alias("nr"))


@query(f"SELECT doc_id, count(*) AS n, string_agg('<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>', '' ORDER BY nr) AS html FROM ({LINES_SQL}) WHERE text <> '' GROUP BY 1")
def imp4_docx_html(t):
    from vellum.sources.office import read_docx

    files = t.documents.select("doc_id", docx_udf("text").alias("content"))
    blocks = read_docx(files, "doc_id")
    n = blocks.where(F.array_join(F.transform("runs", lambda r: r["text"]), "") != "").groupBy("doc_id").agg(F.count("*").alias("n"))
    return assemble.docx_html(blocks, "doc_id").select("doc_id", "html").join(n, "doc_id")


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS slide, text FROM ({LINES_SQL}) WHERE trim(text) <> ''")
def src14_pptx_slides(t):
    from vellum.sources.office import read_pptx

    files = t.documents.select("doc_id", pptx_udf("text").alias("content"))
    return read_pptx(files, "doc_id").where("kind = 'text'").select("doc_id", long("slide").alias("slide"), "text")


@query("SELECT n_regionkey, n_name, n_nationkey::BIGINT AS nr FROM nation")
def src8_js_literals(t):
    """Nations written as a script's literal for each region, and parsed."""
    from vellum.sources.literals import literal_json_udf

    entry = F.concat(F.lit("{ id: "), F.col("n_nationkey").cast("string"), F.lit(", name: '"), "n_name", F.lit("', /* c */ },"))
    scripts = t.nation.withColumn("entry", entry).groupBy("n_regionkey").agg(F.concat(F.lit("window.X = { topics: ["), sequence.text_in_order("entry", ["n_nationkey"]), F.lit("], };")).alias("js"))
    doc = F.from_json(literal_json_udf("js"), "topics array<struct<id:long,name:string>>")
    return scripts.select("n_regionkey", F.explode(doc["topics"]).alias("x")).select("n_regionkey", F.col("x.name").alias("n_name"), F.col("x.id").alias("nr"))


@query("SELECT n_regionkey, n_name AS title, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ord, 'p/' || n_nationkey || '.html' AS zip_path, 'R' || n_regionkey AS module, n_regionkey = 1 AS hidden FROM nation")
def imp1_package_topics(t):
    """A package with a manifest for each region, read back."""
    from vellum.sources.files import unzip
    from vellum.sources.package import topics

    k = F.col("n_nationkey").cast("string")
    rows = t.nation.withColumn("item", F.concat(F.lit("<item identifierref='i"), k, F.lit("'><title>"), "n_name", F.lit("</title></item>"))).withColumn("res", F.concat(F.lit("<resource identifier='i"), k, F.lit("' href='"), k, F.lit(".html'/>")))
    per = rows.groupBy("n_regionkey").agg(sequence.text_in_order("item", ["n_nationkey"]).alias("items"), sequence.text_in_order("res", ["n_nationkey"]).alias("res"))
    xml = F.concat(F.lit("<manifest><organizations><organization><item isvisible='"), F.when(F.col("n_regionkey") == 1, "False").otherwise("True"), F.lit("'><title>R"), F.col("n_regionkey").cast("string"), F.lit("</title>"), "items", F.lit("</item></organization></organizations><resources>"), "res", F.lit("</resources></manifest>"))
    packed = per.select("n_regionkey", assemble.zip_udf(F.array(F.lit("p/imsmanifest.xml")), F.array(xml)).alias("content"))
    got = topics(unzip(packed, "n_regionkey"), "n_regionkey")
    return got.select("n_regionkey", "title", long("ord").alias("ord"), "zip_path", F.array_join("module", ">").alias("module"), "hidden")


@query("SELECT c_custkey, 'S' || c_custkey AS code, c_name AS proposal, c_mktsegment AS note FROM customer")
def src18_proposals(t):
    body = F.concat(F.lit("## S"), F.col("c_custkey").cast("string"), F.lit(" \n"), "c_name", F.lit("\n\nVoor de lector: "), "c_mktsegment", F.lit("\n"))
    files = t.customer.withColumn("b", body).groupBy("c_nationkey").agg(F.concat(F.lit("# T\n"), sequence.text_in_order("b", ["c_custkey"])).alias("text"))
    return answers.proposals(files, "c_nationkey").select(F.regexp_extract("code", r"\d+", 0).cast("long").alias("c_custkey"), "code", "proposal", "note")


@query("SELECT p_partkey, 'vraag' AS kind, p_partkey::VARCHAR AS name, p_name AS body FROM part")
def src19_answer_blocks(t):
    body = F.concat(F.lit("## Vraag "), F.col("p_partkey").cast("string"), F.lit("\n"), "p_name", F.lit("\n"))
    files = t.part.withColumn("b", body).groupBy("p_brand").agg(sequence.text_in_order("b", ["p_partkey"]).alias("text"))
    got = answers.answer_blocks(files, "p_brand").where("kind is not null")
    return got.select(F.col("name").cast("long").alias("p_partkey"), "kind", "name", "body")


@query("""SELECT coalesce(o_custkey, c_custkey) AS k, CASE WHEN n IS NULL THEN 'no answer' WHEN c_custkey IS NULL THEN 'answers nothing' WHEN n > 1 THEN 'answered twice' END AS problem
FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def j15_match_answers(t):
    wanted = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return answers.match_answers(wanted, t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("body")), ["k"]).select("k", "problem")


# ---------------------------------------------------------------- questions and slides


def line_questions(t: Tables) -> DataFrame:
    """Each document as a page of choice questions: a line is a question, its first words are choices, the first is correct."""
    words = lambda x: F.slice(F.filter(F.split(tx.escape(x), " "), lambda w: w != ""), F.lit(1), F.lit(4))
    choices = lambda x: F.array_join(F.transform(words(x), lambda w, i: F.concat(F.lit("<li"), F.when(i == 0, ' class="juist"').otherwise(""), F.lit(">"), w, F.lit("</li>"))), "")
    item = lambda x: F.concat(F.lit("<li>q<ul>"), choices(x), F.lit("</ul></li>"))
    return t.documents.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit('<h2>H</h2><ol class="vragen">'), F.array_join(F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), item), ""), F.lit("</ol>")).alias("html"))


QUESTIONS_SQL = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS nr, least(len(list_filter(string_split(text, ' '), lambda w: w <> '')), 4)::BIGINT AS n_choices FROM ({LINES_SQL}) WHERE trim(text) <> ''"


@query(QUESTIONS_SQL)
def ext19_question_rows(t):
    rows = assemble.question_rows(line_questions(t))
    return rows.where("status = 'ok'").select(F.col("path").cast("long").alias("doc_id"), long("nr").alias("nr"), long(F.size("choices")).alias("n_choices"))


@query(f"SELECT doc_id, 'a' AS letter, count(*) AS n, count(*) AS total FROM ({QUESTIONS_SQL}) GROUP BY 1 HAVING count(*) >= 4")
def agg4_letter_skew(t):
    return assemble.letter_skew(assemble.question_rows(line_questions(t))).select(F.col("path").cast("long").alias("doc_id"), "letter", "n", "total")


@query(f"SELECT doc_id, nr, 'H' AS heading FROM ({QUESTIONS_SQL})")
def j17_question_groups(t):
    return assemble.question_groups(line_questions(t)).select(F.col("path").cast("long").alias("doc_id"), long("nr").alias("nr"), F.col("outer_heading").alias("heading"))


@query(f"SELECT doc_id, nr, '' AS broken FROM ({QUESTIONS_SQL})")
def exp8_items(t):
    """Question items of all documents; each is well-formed XML."""
    got = assemble.items(assemble.question_rows(line_questions(t)), "pkg")
    return got.select(F.col("path").cast("long").alias("doc_id"), long("nr").alias("nr"), kernels.well_formed_udf("xml").alias("broken"))


@query("""SELECT doc_id, CASE WHEN i % 3 = 0 THEN 100 + i ELSE i END::BIGINT AS number, md5(line) AS h FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS lines FROM documents))""")
def ext16_slides(t):
    """A document's lines as slides; every third has a number of its own, others are counted."""
    attrs = lambda i: F.when((i + 1) % 3 == 0, F.concat(F.lit(' data-slide="'), (i + 101).cast("string"), F.lit('"'))).otherwise(F.lit(' data-nr="7"'))
    section = lambda x, i: F.concat(F.lit('<section class="slide wide"'), attrs(i), F.lit(">"), tx.escape(x), F.lit("</section>"))
    decks = t.documents.select(F.col("doc_id").alias("path"), F.array_join(F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), section), "\n").alias("html"))
    got = assemble.slides(decks)
    plain = tx.decode_basic(F.regexp_replace("html", '^<section[^>]*>|</section>$', ""))
    return got.select(F.col("path").alias("doc_id"), long("number").alias("number"), F.md5(plain.cast("binary")).alias("h"))


@query("""SELECT conv_id, count(*) AS n_rows FROM conversations GROUP BY 1""")
def exp7_handout(t):
    slides = t.conversations.select(F.col("conv_id").alias("path"), F.col("turn").alias("pos"), F.col("turn").alias("number"), tx.escape("text").alias("html"))
    return assemble.handout(slides, "T").select(F.col("path").alias("conv_id"), long(F.regexp_count("html", F.lit('<td class="notes">'))).alias("n_rows"))


@query("""WITH f AS (SELECT l_orderkey, l_suppkey * 1000000 + l_partkey AS o, l_suppkey::DOUBLE AS x, l_quantity AS y, 3.0 AS h FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_suppkey, l_partkey) = 1),
b AS (SELECT DISTINCT g.l_orderkey FROM f g JOIN f k ON g.l_orderkey = k.l_orderkey AND g.o < k.o AND g.y < k.y + k.h AND k.y < g.y + g.h)
SELECT f.l_orderkey, o, row_number() OVER (PARTITION BY f.l_orderkey ORDER BY CASE WHEN b.l_orderkey IS NOT NULL THEN x ELSE y END, o) AS place FROM f LEFT JOIN b ON b.l_orderkey = f.l_orderkey""")
def win12_reading_order(t):
    w = Window.partitionBy("l_orderkey", "l_suppkey", "l_partkey")
    f = t.lineitem.withColumn("c", F.count("*").over(w)).where("c = 1").select("l_orderkey", (F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("ord"), F.col("l_suppkey").cast("double").alias("x"), F.col("l_quantity").alias("y"), F.lit(3.0).alias("height"))
    return assemble.reading_order(f, ["l_orderkey"]).select("l_orderkey", F.col("ord").alias("o"), long("place").alias("place"))


# ---------------------------------------------------------------- scalar kernels


@query("SELECT doc_id, text FROM documents")
def str2_unescape(t):
    """Escaped and unescaped again."""
    return t.documents.select("doc_id", kernels.unescape_udf(tx.escape("text", True)).alias("text"))


@query("SELECT c_custkey, replace(lower(c_name), '#', '-') AS slug FROM customer")
def str3_ascii_slug(t):
    return t.customer.select("c_custkey", kernels.ascii_slug_udf(F.regexp_replace("c_name", "#", " # ")).alias("slug"))


@query("SELECT doc_id, strip_accents(text) = text AS plain FROM documents")
def str3c_without_accents(t):
    """Texts of every language, or of none."""
    return t.documents.select("doc_id", (kernels.without_accents_udf("text") == F.col("text")).alias("plain"))


@query("SELECT o_orderkey, 'x = ' || o_custkey || ';' AS line FROM orders")
def str10_spacing(t):
    return t.orders.select("o_orderkey", kernels.spaced_udf(F.concat(F.lit("x="), F.col("o_custkey").cast("string"), F.lit(";"))).alias("line"))


@query("SELECT page_id, regexp_replace(regexp_replace(html, '<(/?)h2', '<\\1h3', 'g'), '<x', '<x', 'g') AS html FROM pages")
def str13_shift_headings(t):
    return t.pages.select("page_id", tx.shift_headings("html").alias("html"))


@query("SELECT n_nationkey, 'assignment' AS kind FROM nation")
def str16_parse_names(t):
    """Names by the grammar, each nation's own module name."""
    names = [r["n_name"] for r in t.nation.orderBy("n_nationkey").collect()]  # one row for each module
    parse = kernels.name_parser(names)
    return t.nation.select("n_nationkey", parse(F.concat(F.lit("Opdracht "), "n_name", F.lit(" (!)")), "n_name").alias("p")).select("n_nationkey", "p.kind")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey::VARCHAR = (o_custkey + 0)::VARCHAR ELSE false END AS same FROM orders")
def str8_same_value(t):
    """Numbers as text equal the number; booleans equal no number."""
    even = F.col("o_custkey") % 2 == 0
    other, kind = F.when(even, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).otherwise("true"), F.when(even, "string").otherwise("boolean")
    return t.orders.select("o_orderkey", tx.same_value(F.col("o_custkey").cast("string"), F.lit("number"), other, kind).alias("same"))


@query("SELECT l_orderkey, l_linenumber, l_quantity / 36000.0 AS mm, least(l_quantity / 96 * 2.54, 15) AS cm FROM lineitem")
def mth1_measures(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", tx.emu_to_mm(F.col("l_quantity")).alias("mm"), tx.figure_cm(F.col("l_quantity")).alias("cm"))


@query("SELECT doc_id, '' AS broken FROM documents")
def xml2_xhtml(t):
    """Documents with stray markup as XHTML; all of it is well formed."""
    x = kernels.xhtml_udf(F.concat(F.lit("<p><b>x<foo>"), tx.escape("text"), F.lit("<br></p>")))["xhtml"]
    return t.documents.select("doc_id", kernels.well_formed_udf(F.concat(F.lit("<r>"), F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), F.lit("</r>"))).alias("broken"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def win8_collision_names(t):
    """As many names that differ in any case of letters as parts of a brand, though many wish the same; a name is its stem, number and extension, since the letters of all names grow with the square of the parts."""
    wanted = F.concat(F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("X"), (F.col("p_size") % 3).cast("string"), F.when(F.col("p_partkey") % 5 == 0, ".PNG").otherwise(".png"))
    assets = t.part.select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("ord"), wanted.alias("wanted"), F.col("p_partkey").cast("string").cast("binary").alias("content"))
    return privacy.stage_assets(assets, "kind", "content", "wanted", ["ord"]).groupBy(F.col("kind").alias("p_brand")).agg(F.countDistinct(F.lower("name_stem"), "name_no", F.lower("name_ext")).alias("n"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang, sha1(text) ORDER BY doc_id) > 1 AS reused FROM documents")
def imp2_stage_assets(t):
    assets = t.documents.select(F.col("lang").alias("kind"), "doc_id", F.concat("source", F.lit(".txt")).alias("wanted"), F.col("text").cast("binary").alias("content"))
    return privacy.stage_assets(assets, "kind", "content", "wanted", ["doc_id"]).select("doc_id", "reused")


@query("SELECT conv_id, turn, len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z]+', '  ', 'g') || ' ', ' (would|there|which|about) ', 1))::BIGINT AS n FROM (SELECT conv_id, turn, regexp_replace(lower(text), '[^\\x00-\\x7f]', 'zz', 'g') AS text FROM conversations)")
def str9_pseudonyms(t):
    _, n = privacy.redacted(F.col("text"), privacy.name_patterns(["Would There", "Which van About"]))
    return t.conversations.select("conv_id", "turn", long(n).alias("n"))


@query(r"""WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(regexp_extract(text, '^[^\n.]*'), '\pL+')) AS w FROM conversations WHERE turn = 0),
tok AS (SELECT DISTINCT CASE WHEN length(w) >= 5 THEN lower(w) ELSE w END AS t FROM names WHERE length(w) >= 3 AND lower(w) NOT IN ('van', 'de', 'der', 'den', 'het', 'ten', 'ter', 'te', 'la', 'le', 'du', 'des', 'da', 'dos', 'el', 'al', 'von', 'zu')),
r AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[\pL\pN]+')) AS w FROM conversations)
SELECT conv_id, turn, count(t)::BIGINT AS n FROM r LEFT JOIN tok ON t = CASE WHEN length(w) >= 5 THEN lower(w) ELSE w END GROUP BY ALL""")
def str9_large_names(t):
    """The words of each conversation's first sentence as names, replaced in all turns."""
    first = t.conversations.where("turn = 0").select(F.regexp_extract("text", r"^[^\n.]*", 0).alias("name"))
    rows = t.conversations.select("conv_id", "turn", "text", F.concat_ws(":", "conv_id", "turn").alias("key"))
    return privacy.redact_large(rows, first, "text", "name", "key").select("conv_id", "turn", long("n_names").alias("n"))


@query(r"""SELECT page_id, md5(regexp_replace(html, '(href|src)="/([^"]*)"', '\1="root:/\2"', 'g') || '<!-- <a href="/c"> --><a href=' || chr(39) || 'root:/' || page_id || chr(39) || ' title="href=&quot;/t&quot;"> href="/text" </a>') AS h FROM pages""")
def rw1_rewritten_references(t):
    """References from the root get a prefix; in comments and plain text nothing does."""
    pages = t.pages.select("page_id", F.concat("html", F.lit("<!-- <a href=\"/c\"> --><a href='/"), F.col("page_id").cast("string"), F.lit("' title=\"href=&quot;/t&quot;\"> href=\"/text\" </a>")).alias("html"))
    refs = rewrite.references(pages, "page_id").select("page_id", "ref").distinct().where(F.col("ref").startswith("/"))
    done = rewrite.rewrite_references(pages, refs.withColumn("new", F.concat(F.lit("root:"), "ref")), "page_id")
    return done.select("page_id", F.md5(F.col("html").cast("binary")).alias("h"))


@query("""SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '<h3>Oefening 3</h3>' ELSE '<h2>Oplossing</h2><p>x</p>' END || '<p>end</p>' AS html FROM pages""")
def rw2_dropped_solutions(t):
    """A solution block after every page, dropped again: with its heading, below another one, and apart from its heading."""
    head = F.when(F.col("page_id") % 3 == 0, "<h2>Oplossing</h2> ").when(F.col("page_id") % 3 == 1, "<h3>Oefening 3</h3>").otherwise("<h2>Oplossing</h2><p>x</p>")
    more = F.concat("html", head, F.lit('<div class="solution-container"><div>a</div></div><p>end</p>'))
    return t.pages.select("page_id", kernels.drop_solutions_udf(more).alias("html"))


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_acctbal < 0")
def j11_setting_changes(t):
    """Segments that differ once customers in debt are renamed."""
    kind = F.lit("string")
    want = t.customer.select("c_custkey", F.lit(None).cast("string").alias("object"), F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value"), kind.alias("kind"))
    have = t.customer.select("c_custkey", F.lit(None).cast("string").alias("object"), F.lit("segment").alias("field"), F.when(F.col("c_acctbal") < 0, "x").otherwise(F.col("c_mktsegment")).alias("value"), kind.alias("kind"))
    return reconcile.setting_changes(want, have, ["c_custkey"]).join(t.customer, "c_custkey").select("c_custkey", F.col("c_name").alias("name"), F.col("want").alias("segment"))


@query("""SELECT o_orderkey, min(l_shipdate) AS first_newer FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate GROUP BY 1""")
def j9_first_newer(t):
    from vellum.plans.rules.stale import first_newer

    d = t.orders.select("o_orderkey", F.col("o_orderdate").alias("mtime"))
    s = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("source_mtime"), F.col("l_shipdate").alias("ord"), F.col("l_partkey").alias("source"))
    return first_newer(d, s, "o_orderkey").select("o_orderkey", F.col("source_mtime").alias("first_newer"))


@query(r"""WITH e AS (SELECT DISTINCT page_id, regexp_replace(regexp_replace(href, '[?#].*$', ''), '^/+', '') AS entry FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages)),
u AS (SELECT page_id, lower(regexp_extract(entry, '[^/]*$')) AS name, count(*) AS n FROM e GROUP BY ALL)
SELECT e.page_id, entry, kind, CASE WHEN kind < 4 OR n = 1 THEN max(entry) OVER (PARTITION BY e.page_id, lower(entry)) END AS found FROM (SELECT *, unnest(range(5)) AS kind FROM e WHERE entry <> '') e JOIN u ON u.page_id = e.page_id AND u.name = lower(regexp_extract(entry, '[^/]*$'))""")
def j21_locate(t):
    """Each file that a page links to, asked for from the root, behind the platform's folder, with dots and in capitals, percent-encoded, and by its name alone."""
    from vellum.sources.package import locate

    href = F.explode(tx.every("html", 'href="(/[^"]*)"')).alias("href")
    entries = t.pages.select("page_id", href).select("page_id", F.regexp_replace(F.regexp_replace("href", "[?#].*$", ""), "^/+", "").alias("entry")).distinct().where("entry <> ''")
    e, name = F.col("entry"), F.substring_index("entry", "/", -1)
    forms = [(F.concat(F.lit("/"), e, F.lit("?x=1#y")), "any"), (F.concat(F.lit("/content/enforced/99-unit/"), e), "any"), (F.concat(F.lit("../q/../../"), F.translate(e, "abcdefgnrst", "ABCDEFGNRST")), "zz/yy"), (F.replace(F.replace(e, F.lit("/"), F.lit("%2F")), F.lit("e"), F.lit("%65")), ""), (F.concat(F.lit("no/where/"), name), "zz")]
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), f.alias("ref"), F.lit(b).alias("base")) for k, (f, b) in enumerate(forms))))
    refs = entries.select("page_id", "entry", asked.alias("a")).select("page_id", "entry", "a.*")
    got = locate(refs, entries, "page_id", "ref", "base")
    return got.select("page_id", "entry", long("kind").alias("kind"), "found")


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def str_latest_merge(t):
    """The streaming snapshot merge, in two waves."""
    from vellum.streaming.incremental import merge_latest

    rows = t.events.select("user_id", "event_id", "ts")
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    first = merge_latest(rows.where(F.col("ts") < half), None, ["user_id"], ["ts", "event_id"])
    return merge_latest(rows.where(F.col("ts") >= half), first, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


