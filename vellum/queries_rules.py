"""Queries of the rules: planted on some pages or entries only, with look-alikes on the others, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.conf import DEFAULTS
from vellum.corpus import Corpus, merge
from vellum.operators import reconcile, sequence
from vellum.plans import report, runner
from vellum.plans.rules import stale
from vellum.queries import ORACLE, QUERIES, Tables, links, long, query
from vellum.queries_more import page_corpus

THEME = '<link rel="stylesheet" href="https://theme.example/style.css"><script src="https://theme.example/main.js"></script>'
CHOICES = '<ol class="vragen"><li>a<ul><li%s>b</li></ul></li><li>c%s</li></ol>'
TABLE = '<table class="verslag-tabel">%s</table>'

#: rule: (folders and name of a page, what pages without a planted case get, a planted case, findings of k planted ones).
#: A page has k = page_id % 3 planted cases; those with none get something that only looks like one, or what the rule wants.
SEEDED = {
    "em-dash": ("Labo/%s.html", " a - b &ndash; c", " a — b &mdash; c", "least(k, 1)"),
    "platform-hotlink": ("Labo/%s.html", "/content/other/1", "/content/enforced/1", "least(k, 1)"),
    "remote-image": ("Labo/%s.html", '<img src="a.png"><a href="https://e.example/a.png">', '<img src="https://e.example/a.png"><img src="http://e.example/b.png">', "2 * k"),
    "remote-document": ("Labo/%s.html", '<a href="https://e.example/a.htm"><a href="a.pdf">', '<a href="https://e.example/a.pdf">a</a>', "k"),
    "youtube-referrer": ("Labo/%s.html", '<iframe src="https://youtube.com/embed/a" referrerpolicy="x"></iframe>', '<iframe src="https://youtube.com/embed/a"></iframe>', "k"),
    "legacy-platform-link": ("Labo/%s.html", '<a href="https://e.example/chamilo">', '<a href="https://chamilo.example/a">a</a>', "k"),
    "theme-wiring": ("Labo/%s.html", THEME, "", "2 * least(k, 1)"),
    "foreign-assets": ("Labo/%s.html", THEME + '<script src="a.js"></script>', '<script src="//cdn.example/a.js"></script>', "k"),
    "checklist-wiring": ("Labo1/%s.html", '<ul class="checklist"></ul><script src="checklist-sync.js"></script><script>initChecklistSync({ labId: "labo1" })</script>', '<ul class="checklist"></ul>', "2 * least(k, 1)"),
    "data-bron": ("Labo/%s.html", '<!-- <p data-bron="no.html"> -->', '<p data-bron="no.html /x.html">', "2 * k"),
    "solution-placement": ("Labo/%s.html", '\n<h2 id="oplossing-1">\n<div class="solution-container">', '\n<h2 id="x">\n<div class="solution-container">', "k"),
    "spoiler-retired": ("Labo/%s.html", '\n<p class="spoiler-container">', '\n<div class="spoiler-container">', "k"),
    "reveal-script-retired": ("Labo/%s.html", '\n<script src="../my-oplossingen.js"></script>', '\n<script src="../oplossingen.js"></script>', "k"),
    "unclosed-comment": ("Labo/%s.html", "<!-- a --><!-- b -->", "<!-- a <!-- b -->", "k"),
    "exercise-name": ("Labo/%s.html", "\n<h1>Begeleide oefening</h1><p>oefening 3</p>", "\n<h1>Oefening 3</h1>", "k"),
    "code-style": ("Labo/%s.html", '\n<pre class="code-wrapper language-c"><code>int a = 1;\nif (a)\n{\n</code></pre><pre class="code-wrapper language-x">a=1;</pre>', '\n<pre class="code-wrapper language-c"><code>int a=1;\nif (a) {\n</code></pre>', "2 * k"),
    "no-verloop": ("Labo/%s/overview.html", "<h2>Het verloop</h2>", "<h2>Verloop</h2>", "least(k, 1)"),
    "no-session-count": ("Labo/%s/overview.html", "<p>Er zijn sessies voorzien.</p>", "<p>drie sessies voorzien</p>", "least(k, 1)"),
    "no-weight": ("Labo/%s/overview.html", "( 20 % )", "[ 20 % ]", "least(k, 1)"),
    "vragen-answered": ("Labo/%s.html", CHOICES % (' class="juist"', '<div class="oplossing">x</div>'), CHOICES % ("", ""), "2 * k"),
    "vragen-numbering": ("Labo/%s.html", '<ol class="vragen"><li>a</li></ol><ol class="vragen" start="2"><li>b</li></ol>', '<ol class="vragen"><li>a</li></ol><ol class="vragen"><li>b</li></ol>', "least(k, 1)"),
    "vragen-class": ("Theorie/Syllabus/Theorie/%s.html", '<ol class="vragen"><li>a <span class="invulruimte"></span></li></ol>', '<ol><li>a <span class="invulruimte"></span></li></ol>', "least(k, 1)"),
    "importer-guess": ("Theorie/Syllabus/Theorie/%s.html", '\n<p data-gerade="a">', '\n<p data-geraden="a">\n<p data-geraden="b">', "2 * k"),
    "verslag-markup": ("Labo/%s/Opdracht.html", '<!-- verslag <ol class="vragen"></ol> -->' + TABLE % "<tr><th>a</th></tr><tr><td>1</td></tr>", '<ol class="vragen"></ol>' + TABLE % "", "least(k, 1) + k"),
    "verslag-controle": ("Labo/%s/Opdracht.html", '</p><p class="controle">Laat dit controleren.</p>', "</p><p>Laat dit controleren.</p>", "k"),
    "verslag-stale": ("Labo/%s/Opdracht.html", "<!-- geen-verslag: none -->", "", "least(k, 1)"),
    "opdracht-lead": ("Labo/%s/Opdracht.html", '<p class="lead">x</p>', '<!-- <p class="lead">x</p> -->', "least(k, 1)"),
    "download-button": ("Labo/%s/Opdracht.html", '<a href="../../downloads/x.docx">Opdracht downloaden</a>', '<a href="../../downloads/x.docx">hier</a>', "least(k, 1)"),
    "spiekblad-stale": ("Labo/%s/Spiekblad.html", '<a href="x-sheet.pdf">', '<a href="x-spiekblad.pdf">', "least(k, 1)"),
    "audit-skip": ("Labo/%s.html", "<!-- audit-skipped: lead -->", "<!-- audit-skip: lead nothing -->", "2 * least(k, 1)"),
    "audit-code-class": ("Labo/%s.html", '<pre class="code-wrapper language-c linenumbers show-language">', '<pre class="code-wrapper language-c">', "2 * k"),
    "audit-lead-opener": ("Labo/%s.html", '<p class="lead">We lezen dit</p>', '<p class="lead">Hier lees je dit</p>', "least(k, 1)"),
    "audit-verkleinwoord": ("Labo/%s.html", " lamp blok ", " lampje blokjes lampje ", "2 * least(k, 1)"),
    "audit-noord-nederlands": ("Labo/%s.html", " primair ", " prima ", "least(k, 1)"),
    "audit-vulwoord": ("Labo/%s.html", " natuurlijke ", " uiteraard natuurlijk ", "2 * least(k, 1)"),
    "audit-led-spelling": ("Labo/%s.html", "\n<p>led</p>\n<code>LED</code>", "\n<p>LED</p>\n<p>LED</p>", "least(k, 1)"),
    "audit-u-vorm": ("Labo/%s.html", "\nje kunt\n", "\nU kunt\nuw\n", "2 * k"),
    "audit-lead": ("Labo/%s.html", '<p class="lead">x</p>', "", "least(k, 1)"),
    "audit-figure": ("Labo/%s.html", "\n<figure><img></figure>\n", "\n<img>\n", "least(k, 1)"),
    "audit-indienen": ("Labo/%s.html", '<h2 id="indienen"></h2><p>Sla je oefening op.</p>', '<h2 id="indienen"></h2>', "least(k, 1)"),
    "audit-oplossing": ("Labo/%s.html", '<h2 id="oplossing">', '<h2 id="x">', "least(k, 1)"),
    "audit-identifier-taal": ("Labo/%s.html", "\n<p>pinLed</p>", "\nint pinLed;\nint pinLed;", "least(k, 1)"),
}


def seeded_rule(id: str) -> None:
    place, other, case, n = SEEDED[id]
    conf = {"check": {"audit": {"exercise_patterns": ["*"], "identifier_words": ["pinLed"]}}}
    mode = "audit" if id.startswith("audit-") else "standard"

    def run(spark, sf_dir: str) -> DataFrame:
        k = (F.col("page_id") % 3).cast("int")
        more = F.when(k == 0, F.lit(other)).otherwise(F.repeat(F.lit(case), k))
        found = runner.findings(page_corpus(Tables(spark, sf_dir), place, more, conf), (mode,), [id])
        return found.select(F.regexp_extract("pad", r"/(\d+)(?:\.html|/[A-Za-z]+\.html)$", 1).cast("long").alias("page_id")).groupBy("page_id").agg(F.count("*").alias("n"))

    name = "rule_" + id.replace("-", "_")
    QUERIES[name] = run
    ORACLE[name] = f"SELECT page_id, ({n})::BIGINT AS n FROM (SELECT page_id, page_id % 3 AS k FROM pages) WHERE k > 0"


for _id in SEEDED:
    seeded_rule(_id)


# ---------------------------------------------------------------- rules across files

SUPPLIER = r"[sS ](\d+)"


def menu_corpus(t: Tables, topic, text=None, conf: dict | None = None) -> Corpus:
    """A course for each nation with a menu of its own, a page and a topic for each of its suppliers; topic: fields of an entry as JSON."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("k", F.col("s_suppkey") % 4).withColumn("key", F.col("s_suppkey").cast("string")).withColumn("page", F.concat(F.lit("Labo/s"), "key", F.lit(".html")))
    course = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("/"))
    modules = rows.withColumn("topic", topic).groupBy("n_nationkey", "n_name").agg(sequence.text_in_order("topic", ["s_suppkey"], ",").alias("items"))
    one = F.concat(F.lit('{"modules": [{"id": "n'), F.col("n_nationkey").cast("string"), F.lit('", "title": "'), "n_name", F.lit('", "name": "'), "n_name", F.lit('", "items": ['), "items", F.lit("]}]}"))
    menus = modules.select(F.concat(course, F.lit("menu.json")).alias("path"), one.alias("html"))
    pages = rows.select(F.concat(course, "page").alias("path"), (F.lit("x") if text is None else text).alias("html"))
    texts = pages.unionAll(menus)
    return Corpus(texts.select("path", F.lit(1.0).alias("mtime"), F.lit(True).alias("tracked")), texts, merge(DEFAULTS, conf or {}), courses=True)


def entry(*fields) -> Column:
    """A topic of the menu with an id and a title of its own and more fields."""
    return F.concat(F.lit('{"id": "t'), "key", F.lit('", "title": "T"'), *fields, F.lit("}"))


def by_k(*cases):
    """One of four by k; a text stands for itself."""
    out = F.lit(None).cast("string")
    for i, c in enumerate(cases):
        out = F.when(F.col("k") == i, F.lit(c) if isinstance(c, str) else c).otherwise(out)
    return out


def supplier_counts(c: Corpus, id: str, of="boodschap", pattern: str = SUPPLIER) -> DataFrame:
    found = runner.findings(c, only=[id])
    return found.select(F.regexp_extract(of, pattern, 1).try_cast("long").alias("s_suppkey")).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, 1::BIGINT AS n FROM supplier WHERE s_suppkey % 4 > 0")
def rule_menu_targets(t):
    """Not a bare path; a page that does not exist; a name in another case; the rest is fine."""
    to = by_k(F.col("page"), F.concat(F.lit("./"), "page"), F.concat(F.lit("no/s"), "key", F.lit(".html")), F.concat(F.lit("labo/s"), "key", F.lit(".html")))
    return supplier_counts(menu_corpus(t, entry(F.lit(', "page": "'), to, F.lit('"'))), "menu-targets")


@query("SELECT s_suppkey, 1::BIGINT AS n FROM supplier WHERE s_suppkey % 4 IN (1, 2)")
def rule_menu_ids(t):
    """An id of another form; an id that occurs twice; an id within an id's words is neither."""
    id_of = by_k(F.concat(F.lit("s"), "key"), F.concat(F.lit("S "), "key"), F.concat(F.lit("s"), "key"), F.concat(F.lit("s"), "key", F.lit("-a")))
    more = by_k("", "", F.concat(F.lit(', "x": {"id": "s'), "key", F.lit('"}')), "")
    return supplier_counts(menu_corpus(t, F.concat(F.lit('{"title": "T", "id": "'), id_of, F.lit('"'), more, F.lit("}"))), "menu-ids", pattern=r"[sS ](\d+)$")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN 2 ELSE 1 END::BIGINT AS n FROM supplier WHERE s_suppkey % 4 > 0")
def rule_menu_qr(t):
    """A code that is no object; an unknown field; both keys, one to a dropbox that is not there."""
    qr = by_k('{"grade": "x", "ans": {"assignment_id": 1, "deadline": 2, "duration": 3, "ioem": 4}}', "1", '{"grade": "x", "z": 1}', '{"grade": "x", "dropbox": "y"}')
    c = menu_corpus(t, F.concat(F.lit('{"id": "s'), "key", F.lit('", "title": "T", "qr": '), qr, F.lit("}")))
    return supplier_counts(c, "menu-qr", pattern=r"topic s(\d+)")


@query("SELECT s_suppkey, 1::BIGINT AS n FROM supplier WHERE s_suppkey % 4 IN (1, 3)")
def rule_menu_names(t):
    """A graded name without its mark; a part with a small letter; well-formed ones of both kinds."""
    box = by_k(F.concat(F.lit("Opdracht "), "n_name", F.lit(": S"), "key", F.lit(" (!)")), F.concat(F.lit("Opdracht "), "n_name", F.lit(": S"), "key"), F.concat(F.lit("Verslag "), "n_name", F.lit(": S"), "key"), F.concat(F.lit("Verslag "), "n_name", F.lit(": s"), "key"))
    return supplier_counts(menu_corpus(t, entry(F.lit(', "dropbox": "'), box, F.lit('"'))), "menu-names", pattern=r": [sS](\d+)")


@query("SELECT s_suppkey, 1::BIGINT AS n FROM supplier WHERE s_suppkey % 4 = 2")
def rule_menu_orphan(t):
    """A page that the menu does not have; one that it has as instructions is covered."""
    to = by_k(F.concat(F.lit(', "page": "'), "page", F.lit('"')), F.concat(F.lit(', "instructions": "'), "page", F.lit('"')), F.concat(F.lit(', "file": "'), "page", F.lit('"')), F.concat(F.lit(', "page": "'), "page", F.lit('"')))
    return supplier_counts(menu_corpus(t, entry(to)), "menu-orphan", "pad")


@query("SELECT s_suppkey, 2::BIGINT AS n FROM (SELECT *, lag(s_suppkey) OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS before FROM supplier) WHERE s_suppkey % 4 = 1 AND before IS NOT NULL")
def rule_topic_frame(t):
    """Two links to the course's page before in the frame; links in a new one, to itself, to a file, in a comment, and to another course's page that is not there."""
    rows = t.supplier.withColumn("s_nationkey", (F.col("s_suppkey") % 3).cast("int"))
    rows = rows.withColumn("before", F.lag("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    before = F.coalesce(F.col("before").cast("string"), F.lit("-none"))
    a = F.concat(F.lit('<a href="s'), before, F.lit(".html#x\"><a  href='s"), before, F.lit(".html'>"))
    text = by_k(F.concat(F.lit('<a target="_blank" href="s'), before, F.lit('.html">')), a, F.concat(F.lit("<!-- "), a, F.lit(" -->")), F.concat(F.lit('<a href="s'), "key", F.lit('.html#y"><a href="x.pdf">')))
    own = Tables(t.spark, t.dir)
    own.supplier = rows
    return supplier_counts(menu_corpus(own, entry(F.lit(', "page": "'), F.col("page"), F.lit('"')), text), "topic-frame", "pad")


@query("SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 1 ELSE 0 END::BIGINT AS n FROM pages")
def rule_duplicate_lead(t):
    """Two leads of one module for each page: equal but for markup, apart by a word, and in another module."""
    words = F.concat(*(F.concat(F.lit(f" w{i}x"), F.col("page_id").cast("string")) for i in range(7)))
    k = F.col("page_id") % 3
    lead = lambda text: F.concat(F.lit('<p class="lead">'), text, F.lit("</p>"), "html")
    over = t.pages.select(F.concat(F.lit("Labo/m"), F.col("page_id").cast("string"), F.lit("/overview.html")).alias("path"), lead(words).alias("html"))
    other = F.when(k == 1, F.regexp_replace(words, " w3", " <b></b>w3")).when(k == 2, F.regexp_replace(words, " w3", " and w3")).otherwise(words)
    folder = F.when(k == 0, F.concat(F.lit("Labo/x"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("Labo/m"), F.col("page_id").cast("string")))
    tasks = t.pages.select(F.concat(folder, F.lit("/Opdracht.html")).alias("path"), lead(other).alias("html"))
    texts = over.unionAll(tasks)
    found = runner.findings(Corpus(texts.select("path", F.lit(1.0).alias("mtime"), F.lit(True).alias("tracked")), texts), only=["duplicate-lead"])
    counted = found.groupBy(F.regexp_extract("pad", r"m(\d+)/", 1).try_cast("long").alias("p")).agg(F.count("*").alias("c"))
    return t.pages.join(counted, F.col("page_id") == F.col("p"), "left").select("page_id", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT page_id FROM pages WHERE page_id % 2 = 0)")
def rule_orphan_image(t):
    """An image for each supplier; pages with an even number name the image of that number, the others a longer name."""
    images = t.supplier.select(F.concat(F.lit("img/syllabus-"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("path"))
    name = F.concat(F.when(F.col("page_id") % 2 == 0, "syllabus-").otherwise("syllabus-0"), F.col("page_id").cast("string"), F.lit(".png"))
    pages = page_corpus(t, "Labo/%s.html", F.concat(F.lit('<img src="../img/'), name, F.lit('">')))
    files = pages.files.unionAll(images.select("path", F.lit(1.0), F.lit(True)))
    found = runner.findings(Corpus(files, pages.texts), only=["orphan-image"])
    return found.select(F.regexp_extract("pad", r"-(\d+)\.png", 1).cast("long").alias("s_suppkey"))


def one_text(path: str, rows: DataFrame, text, order: list[str], before: str = "", after: str = "") -> DataFrame:
    """A file of the corpus that is put together from rows."""
    return rows.withColumn("t", text).groupBy().agg(sequence.text_in_order("t", order, "\n").alias("t")).select(F.lit(path).alias("path"), F.concat(F.lit(before), F.coalesce("t", F.lit("")), F.lit(after)).alias("html"))


def file_corpus(texts: DataFrame, more: DataFrame | None = None, conf: dict | None = None) -> Corpus:
    """texts(path, html) as files of time 1, and further files(path, mtime)."""
    files = texts.select("path", F.lit(1.0).alias("mtime"))
    files = files.unionAll(more.select("path", "mtime")) if more is not None else files
    return Corpus(files.select("path", "mtime", F.lit(True).alias("tracked")), texts, merge(DEFAULTS, conf or {}))


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS line FROM customer QUALIFY c_custkey % 3 = 1 UNION ALL SELECT DISTINCT c_nationkey, NULL, NULL FROM customer WHERE c_nationkey % 2 = 0")
def rule_schrijfstijl_nummers(t):
    """A guide for each nation with a section for each of its customers; the base lacks the numbers that leave 1, and half the guides do not refer to it."""
    line = F.concat(F.lit("## "), F.col("c_custkey").cast("string"), F.lit(". "), "c_name")
    head = F.when(F.col("c_nationkey") % 2 == 0, "# Guide\n").otherwise(F.lit("# see ../base.md\n"))
    guides = t.customer.withColumn("t", line).groupBy("c_nationkey").agg(sequence.text_in_order("t", ["c_custkey"], "\n").alias("t")).select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/SCHRIJFSTIJL.md")).alias("path"), F.concat(head, "t").alias("html"))
    top = t.customer.agg(F.max("c_custkey")).first()[0] or 0
    c = file_corpus(guides, conf={"style_guide": {"base_numbers": [n for n in range(top + 1) if n % 3 != 1], "reference": "../base.md"}})
    c.courses = True
    found = runner.findings(c, only=["schrijfstijl-nummers"])
    return found.select(F.regexp_extract("pad", r"n(\d+)/", 1).cast("int").alias("c_nationkey"), F.regexp_extract("boodschap", r"pattern (\d+)", 1).try_cast("long").alias("c_custkey"), F.col("regelnr").cast("long").alias("line"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 1 THEN 'a skill folder without its file' WHEN 2 THEN 'no base of this name' ELSE 'does not refer to its base' END AS cause FROM nation WHERE n_nationkey % 4 > 0")
def rule_skill_basis(t):
    """A skill folder for each nation: whole, without its file, of an unknown base, without its reference."""
    rows = t.nation.withColumn("k", F.col("n_nationkey") % 4).withColumn("key", F.col("n_nationkey").cast("string"))
    path = F.concat(F.lit(".claude/skills/base-"), by_k("n", "n", "u", "n"), "key", by_k("/SKILL.md", "/other.md", "/SKILL.md", "/SKILL.md"))
    texts = rows.select(path.alias("path"), by_k(F.concat(F.lit("see base/n"), "key", F.lit(".md")), "x", "x", "see base/other.md").alias("html"))
    base = {f"n{i}": f"base/n{i}.md" for i in range(1000)}
    found = runner.findings(file_corpus(texts, conf={"skills": {"base": base}}), only=["skill-basis"])
    return found.select(F.regexp_extract("pad", r"base-[nu](\d+)", 1).cast("long").alias("n_nationkey"), F.col("boodschap").alias("cause"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN 2 ELSE 1 END::BIGINT AS n FROM supplier WHERE s_suppkey % 4 > 0")
def rule_syllabus_manifest(t):
    """A chapter and a topic for each supplier: listed, with no name, not listed, and listed by a name in another case (twice wrong)."""
    rows = t.supplier.withColumn("k", F.col("s_suppkey") % 4).withColumn("key", F.col("s_suppkey").cast("string"))
    topic = F.concat(F.lit("{ id: 's"), "key", F.lit("', name: '"), by_k("T", "", "T", "T"), F.lit("', href: '"), by_k("s", "s", "s", "S"), "key", F.lit(".html' },"))
    manifest = one_text("reference.js", rows.where("k <> 2"), topic, ["s_suppkey"], "window.R = { syllabus: { categories: [ { name: 'A', topics: [\n", "\n] } ] } };")
    pages = rows.select(F.concat(F.lit("Theorie/Syllabus/Theorie/s"), "key", F.lit(".html")).alias("path"), F.lit("x").alias("html"))
    found = runner.findings(file_corpus(pages.unionAll(manifest)), only=["syllabus-manifest"])
    own = found.where("boodschap not like '%a field is missing%'").select(F.regexp_extract(F.concat("pad", F.lit(" "), "boodschap"), r"[sS](\d+)\.html", 1).cast("long").alias("s_suppkey"))
    return own.unionAll(rows.where("k = 1").select("s_suppkey")).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'the deck' ELSE 'an image' END AS newer FROM supplier WHERE s_suppkey % 4 IN (1, 3)")
def rule_handout_stale(t):
    """A deck and its handout for each supplier: newer than all, older than the deck, without handout, older than an image only."""
    rows = t.supplier.withColumn("k", F.col("s_suppkey") % 4).withColumn("key", F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij"))
    decks = rows.select(F.concat(F.lit("Hoorcollege/S"), "key", F.lit(".html")).alias("path"), F.concat(F.lit('<img src="../img/i'), "key", F.lit('.png">')).alias("html"))
    times = rows.where("k <> 2").select(F.concat(F.lit("downloads/h-s"), "key", F.lit(".pdf")).alias("path"), by_k("3", "0", "0", "2").cast("double").alias("mtime"))
    images = rows.select(F.concat(F.lit("img/i"), "key", F.lit(".png")).alias("path"), by_k("2", "0", "3", "3").cast("double").alias("mtime"))
    found = runner.findings(file_corpus(decks, times.unionAll(images), {"handout": {"prefix": "h-"}}), only=["handout-stale"])
    return found.select(F.translate(F.regexp_extract("pad", r"h-s([a-j]+)", 1), "abcdefghij", "0123456789").cast("long").alias("s_suppkey"), F.when(F.col("boodschap").contains("Hoorcollege/"), "the deck").otherwise("an image").alias("newer"))


@query("SELECT 'Theorie/Syllabus/Theorie/s' || min(s_suppkey::VARCHAR) || '.html' AS newer FROM supplier WHERE s_suppkey % 4 = 3 HAVING count(*) > 0")
def rule_syllabus_stale(t):
    """A chapter for each supplier, a quarter of them newer than the one file; the first of those by path counts."""
    path = F.concat(F.lit("Theorie/Syllabus/Theorie/s"), F.col("s_suppkey").cast("string"), F.lit(".html"))
    texts = t.supplier.select(path.alias("path"), F.lit("x").alias("html"))
    times = t.supplier.select(path.alias("path"), F.when(F.col("s_suppkey") % 4 == 3, 9.0).otherwise(1.0).alias("mtime")).unionAll(t.spark.createDataFrame([("downloads/s.pdf", 5.0)], "path string, mtime double"))
    c = Corpus(times.select("path", "mtime", F.lit(True).alias("tracked")), texts, merge(DEFAULTS, {"syllabus": {"pdf": "s.pdf"}}))
    return runner.findings(c, only=["syllabus-stale"]).select(F.regexp_replace("boodschap", "^is older than ", "").alias("newer"))


# ---------------------------------------------------------------- further operators


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE coalesce(c_acctbal < 0, false) = false GROUP BY 1 HAVING count(*) > 1")
def flt9_not_trashed(t):
    """Customers in debt are in the trash; those with an unknown balance would not be."""
    rows = t.customer.withColumn("trashed", F.when(F.col("c_acctbal") < 0, True).when(F.col("c_acctbal") > 5000, False))
    return reconcile.at_most_one(rows, "c_mktsegment", "c_custkey", "trashed").select("c_mktsegment", "n")


@query("SELECT page_id FROM pages WHERE page_id % 4 IN (0, 1)")
def hlp1_question_pages(t):
    """A question list on every page but for a quarter, where it is in a comment; pages of the tests' folder count, of another staging folder not."""
    k = F.col("page_id") % 4
    folder = F.when(k == 0, "Labo").when(k == 1, "_toets").when(k == 2, "_export").otherwise("Labo")
    mark = F.when(k == 3, '<!-- <ol class="vragen"><li>a</li></ol> -->').otherwise('<ol class="vragen"><li>a</li></ol>')
    texts = t.pages.select(F.concat_ws("/", folder, F.concat(F.col("page_id").cast("string"), F.lit(".html"))).alias("path"), F.concat("html", mark).alias("html"))
    c = Corpus(texts.select("path", F.lit(1.0).alias("mtime"), F.lit(True).alias("tracked")), texts)
    return c.question_pages().select(F.regexp_extract("path", r"/(\d+)\.html", 1).cast("long").alias("page_id"))


def settings(t: Tables) -> DataFrame:
    """Settings of a test for each customer: a cover for all, a publication for some, a score, and what is checked by hand."""
    doc = F.struct(F.struct(F.col("c_name").alias("text")).alias("cover"), F.when(F.col("c_custkey") % 2 == 0, F.struct(F.col("c_nationkey").alias("at"))).alias("publication"), F.struct(F.col("c_nationkey").alias("score")).alias("grades_settings"), F.lit("x").alias("title"), F.array(F.lit("first"), F.col("c_mktsegment")).alias("met_de_hand"))
    return t.customer.select("c_custkey", F.to_json(doc).alias("doc"))


@query("""SELECT c_custkey, false AS item_bank, 'cover' AS part, '{"text":"' || c_name || '"}' AS value FROM customer UNION ALL SELECT c_custkey, false, 'publication', '{"at":' || c_nationkey || '}' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, true, 'cover', '{"text":"' || c_name || '"}' FROM customer UNION ALL SELECT c_custkey, true, 'grades_settings', '{"score":' || c_nationkey || '}' FROM customer""")
def hlp4_configured_parts(t):
    both = [reconcile.configured_parts(settings(t), ["c_custkey"], "doc", bank).withColumn("item_bank", F.lit(bank)) for bank in (False, True)]
    return both[0].unionByName(both[1])


@query("""SELECT c_custkey, 0::BIGINT AS ord, 'first' AS text FROM customer UNION ALL SELECT c_custkey, 1, CASE WHEN len(c_mktsegment) <= 9 THEN c_mktsegment ELSE left(c_mktsegment, 6) || '...' END FROM customer""")
def hlp7_manual_rows(t):
    rows = reconcile.manual_rows(settings(t), ["c_custkey"], "doc")
    return rows.select("c_custkey", long("ord").alias("ord"), reconcile.shortened(F.col("text"), 9).alias("text"))


@query("SELECT page_id, 'Labo/m' || page_id AS owner FROM pages")
def hlp10_sheet_owner(t):
    """Half of the sheets stand in a folder of theory of their lab."""
    key = F.col("page_id").cast("string")
    path = F.concat(F.lit("Labo/m"), key, F.when(F.col("page_id") % 2 == 0, "/Theorie").otherwise(""), F.lit("/Spiekblad.html"))
    return t.pages.select("page_id", path.alias("path")).select("page_id", stale.sheet_owner("path").alias("owner"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY lower(name), s_suppkey) AS place FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE lower(s_name) END AS name FROM supplier)")
def srt3_by_name(t):
    """Places in the order of names in mixed case; read off the sorted partitions by a running number."""
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.lower("s_name")).alias("name"))
    numbered = reconcile.by_name(rows, "name", "s_suppkey").select("s_suppkey", F.monotonically_increasing_id().alias("i"))
    # numbers over range partitions: a count of each partition goes before the row's own place
    numbered = numbered.withColumn("part", F.shiftright("i", 33)).withColumn("own", F.col("i").bitwiseAND(F.lit((1 << 33) - 1)))
    per = numbered.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return numbered.join(per, "part").select("s_suppkey", (F.coalesce("before", F.lit(0)) + F.col("own") + 1).alias("place"))


@query("""SELECT row_number() OVER (ORDER BY ernst <> 'fout', pad) AS place, pad, ernst FROM (SELECT 'Labo/' || page_id || '.html' AS pad, CASE WHEN page_id % 2 = 0 THEN 'fout' ELSE 'waarschuwing' END AS ernst FROM pages)""")
def srt1_ordered_findings(t):
    """Findings in their order: errors first, then by path."""
    found = t.pages.select(F.concat(F.lit("Labo/"), F.col("page_id").cast("string"), F.lit(".html")).alias("pad"), F.when(F.col("page_id") % 2 == 0, "fout").otherwise("waarschuwing").alias("ernst"), F.lit(0).alias("ord"), F.lit(None).cast("int").alias("regelnr"), F.lit("x").alias("boodschap"))
    listed = report.ordered(found).select("pad", "ernst").withColumn("i", F.monotonically_increasing_id())
    listed = listed.withColumn("part", F.shiftright("i", 33)).withColumn("own", F.col("i").bitwiseAND(F.lit((1 << 33) - 1)))
    per = listed.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return listed.join(per, "part").select((F.coalesce("before", F.lit(0)) + F.col("own") + 1).alias("place"), "pad", "ernst")


@query("""SELECT page_id, 'Labo/' || page_id || '.html' AS path, replace(html, chr(10), chr(10)) || CASE WHEN page_id % 2 = 0 THEN chr(10) || '<script src="a/oplossingen2.js"></script>' ELSE '' END AS html FROM pages""")
def fix5_retired_includes(t):
    """Includes of retired scripts go with their line; one of a longer name stays."""
    from vellum.operators.repair import repaired

    more = F.when(F.col("page_id") % 2 == 0, '\n<script src="a/oplossingen2.js"></script>').otherwise('\n<script src="a/solution-reveal.js"></script>')
    done = repaired(page_corpus(t, "Labo/%s.html", more))
    return done.select(F.regexp_extract("path", r"(\d+)\.html", 1).cast("long").alias("page_id"), "path", "html")


@query("""SELECT page_id, '<pre class="code-wrapper language-c"><code>' || chr(10) || CASE page_id % 4 WHEN 0 THEN 'x' || page_id || ' = f(a, b);' WHEN 1 THEN 'x' || page_id || '+=1; // a=b' WHEN 2 THEN 'List&lt;int&gt; x' || page_id || ' = y;' ELSE 'p' || page_id || '->q = a<<2;' END || chr(10) || '</code></pre>x=1;' AS html FROM pages""")
def fix3_operator_spacing(t):
    """Assignments and commas get blanks within code blocks; compound ones, comments, types, arrows and shifts do not, nor does text outside."""
    from vellum.operators.repair import repaired

    key, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    line = F.when(k == 0, F.concat(F.lit("x"), key, F.lit("=f(a,b);"))).when(k == 1, F.concat(F.lit("x"), key, F.lit("+=1; // a=b"))).when(k == 2, F.concat(F.lit("List&lt;int&gt; x"), key, F.lit("=y;"))).otherwise(F.concat(F.lit("p"), key, F.lit("->q=a<<2;")))
    html = F.concat(F.lit('<pre class="code-wrapper language-c"><code>\n'), line, F.lit("\n</code></pre>x=1;"))
    texts = t.pages.select(F.concat(F.lit("Labo/"), key, F.lit(".html")).alias("path"), html.alias("html"))
    return repaired(file_corpus(texts)).select(F.regexp_extract("path", r"(\d+)\.html", 1).cast("long").alias("page_id"), "html")


@query("""SELECT k, 'only_a' AS side, count(*) AS n FROM (SELECT c_mktsegment AS k FROM customer WHERE c_custkey % 2 = 0 EXCEPT ALL SELECT c_mktsegment FROM customer WHERE c_custkey % 2 = 1) GROUP BY 1
UNION ALL SELECT k, 'only_b', count(*) FROM (SELECT c_mktsegment AS k FROM customer WHERE c_custkey % 2 = 1 EXCEPT ALL SELECT c_mktsegment FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1""")
def agg17_surplus(t):
    """How often more one side has a value than the other."""
    side = lambda k: t.customer.where(F.col("c_custkey") % 2 == k).select(F.col("c_mktsegment").alias("k"))
    return reconcile.multiset_difference(side(0), side(1)).groupBy("k", "side").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, href, CASE WHEN low LIKE '/d2l/%' THEN false ELSE low LIKE '/%' AND low NOT LIKE '//%' END AS inside FROM (SELECT page_id, href, href AS low FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)\s*=\s*"([^"]+)"', 1)) AS href FROM pages)) WHERE href LIKE '/%' OR href LIKE 'http%' OR href LIKE '#%'""")
def pth3_inside(t):
    """Which references lead into the corpus rather than out of it."""
    from vellum.plans.rules.links import OUTSIDE, starts_with_any

    return links(t).where(starts_with_any(F.col("href"), ("/", "http", "#"))).select("page_id", "href", (~starts_with_any(F.col("href"), OUTSIDE)).alias("inside"))
