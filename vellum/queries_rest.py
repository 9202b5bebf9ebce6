"""Queries of helpers and of the smaller operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import kernels
from vellum.functions import text as tx
from vellum.functions.tokens import TEXTS
from vellum.operators import answers, assemble, feedback, menu, privacy, reconcile, rewrite, sequence, worklist
from vellum.queries import long, paths, query
from vellum.queries_more import LINES_SQL, QUESTIONS_SQL, docx_udf, line_questions, nation_menus, page_corpus

# ---------------------------------------------------------------- filters


@query("SELECT page_id, page_id % 2 = 0 AS is_site FROM pages")
def flt3_site_pages(t):
    """Pages laid in a site folder or a folder of decks, by parity of their id; the folder decides."""
    from vellum.corpus import Corpus
    from vellum.conf import DEFAULTS, merge

    where = F.concat(F.when(F.col("page_id") % 2 == 0, "Labo/").otherwise("Hoorcollege/"), F.col("page_id").cast("string"), F.lit(".html"))
    texts = t.pages.select(where.alias("path"), "html")
    c = Corpus(texts.select("path", F.lit(1.0).alias("mtime"), F.lit(True).alias("tracked")), texts, merge(DEFAULTS, {}))
    return c.pages.select(F.regexp_extract("path", r"/(\d+)\.html", 1).cast("long").alias("page_id"), "is_site")


@query("SELECT count(*) AS n_audit, count(*) AS n_checked FROM pages")
def flt4_audit_pages(t):
    return page_corpus(t, "Labo/%s.html").pages.agg(F.count_if("is_audit").alias("n_audit"), F.count_if("is_checked").alias("n_checked"))


@query("SELECT page_id FROM pages")
def flt5_fixed_depth(t):
    p = F.concat(F.lit("Labo/"), F.col("page_id").cast("string"), F.lit("/overview.html"))
    return t.pages.where(tx.depth_glob(p, "overview.html", (2,)) & ~tx.depth_glob(p, "overview.html", (3,))).select("page_id")


@query("SELECT doc_id, CASE WHEN strlen(text) > 20000 THEN 'larger than 0 MB' END AS reason FROM documents")
def flt8_size_cap(t):
    size = F.octet_length("text")
    return t.documents.select("doc_id", F.when(size > 20000, F.format_string("larger than %d MB", F.lit(0))).alias("reason"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'docx' WHEN 'O' THEN 'image' ELSE 'code' END AS kind FROM orders")
def flt10_file_kinds(t):
    from vellum.sources.files import file_kind

    name = F.concat(F.lit("a/x."), F.when(F.col("o_orderstatus") == "F", "DOCX").when(F.col("o_orderstatus") == "O", "png").otherwise("py"))
    return t.orders.select("o_orderkey", name.alias("name")).select("o_orderkey", file_kind().alias("kind"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 40 OR l_partkey < 40 THEN 'small' WHEN l_partkey > 1600 THEN 'resize' ELSE 'keep' END AS disposition FROM lineitem")
def flt11_images(t):
    images = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("h"), F.col("l_partkey").cast("string")).alias("sha"), F.lit(".png").alias("ext"), F.col("l_partkey").cast("int").alias("width"), F.col("l_quantity").cast("int").alias("height"))
    out = feedback.image_disposition(images, t.spark.createDataFrame([("none",)], "sha string"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "disposition")


@query("SELECT 56::BIGINT AS n_rules")
def flt12_rule_status(t):
    """How many rules there are, whatever their state on the pages table."""
    from vellum.plans.runner import rules_status

    return rules_status(page_corpus(t, "Labo/%s.html"), ("standard", "audit")).agg(F.count("*").alias("n_rules"))


# ---------------------------------------------------------------- extraction


@query("SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\s[^>]*>'))::BIGINT AS n FROM pages")
def ext2_anchors(t):
    return t.pages.select("page_id", long(F.size(tx.every("html", r"(?is)(<a\s[^>]*>)"))).alias("n"))


@query(f"SELECT doc_id, nr, text AS line FROM ({LINES_SQL})")
def ext6_code_lines(t):
    """Each document as a code block, its lines with their numbers on the page."""
    from vellum.corpus import Corpus
    from vellum.plans.rules.code import code_lines

    html = F.concat(F.lit('<pre class="code-wrapper language-c"><code>'), tx.escape("text"), F.lit("</code></pre>"))
    texts = t.documents.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), html.alias("html"))
    c = Corpus(texts.select("path", F.lit(1.0).alias("mtime"), F.lit(True).alias("tracked")), texts)
    line = tx.decode_basic(F.regexp_replace(F.regexp_replace("line", "^<code>", ""), "</code>$", ""))
    return code_lines(c).select(F.regexp_extract("path", r"(\d+)\.html", 1).cast("long").alias("doc_id"), long("nr").alias("nr"), line.alias("line"))


@query(f"SELECT doc_id, nr, n_choices FROM ({QUESTIONS_SQL})")
def ext7_list_items(t):
    rows = line_questions(t).select("path", F.explode(kernels.question_lists_udf("html")).alias("l")).select("path", F.posexplode("l.items").alias("pos", "i"))
    return rows.select(F.col("path").cast("long").alias("doc_id"), long(F.col("pos") + 1).alias("nr"), long(F.size(kernels.choices_udf("i.body"))).alias("n_choices"))


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS nr, text AS body FROM ({LINES_SQL}) WHERE trim(text) <> ''")
def ext10_objectives(t):
    items = F.array_join(F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("<li>"), tx.escape(x), F.lit("</li>"))), "")
    html = F.concat(F.lit('<ol><li>no</li></ol><h2 id="doelstellingen">D</h2><ol>'), items, F.lit("</ol><h2>x</h2><ol><li>no</li></ol>"))
    rows = t.documents.select("doc_id", F.posexplode(kernels.objectives_udf(html)).alias("pos", "o"))
    return rows.select("doc_id", long(F.col("pos") + 1).alias("nr"), tx.decode_basic("o.body").alias("body"))


@query("SELECT conv_id, turn, unnest(list_filter(string_split(trim(regexp_replace(role || ' x/' || conv_id, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS src FROM conversations")
def ext11_sources(t):
    html = F.concat(F.lit('<p data-bron=" '), "role", F.lit("  x/"), F.col("conv_id").cast("string"), F.lit('">'))
    src = F.explode(F.split(tx.squeeze(tx.first(html, r'\bdata-bron="([^"]*)"')), " "))
    return t.conversations.select("conv_id", "turn", src.alias("src"))


@query("SELECT page_id, 1::BIGINT + len(html) - len(replace(html, chr(10), '')) AS nr FROM pages")
def ext12_unclosed(t):
    rows = t.pages.select("page_id", F.explode(kernels.unclosed_udf(F.concat("html", F.lit("<!-- a <!-- b -->")))).alias("nr"))
    return rows.withColumn("nr", long("nr"))


@query(r"SELECT page_id, len(regexp_extract_all(lower(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)), '[a-z]+'))::BIGINT AS n FROM pages")
def ext15_lead_words(t):
    return t.pages.select("page_id", long(F.size(tx.every(F.lower(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)), "[a-z]+", 0))).alias("n"))


@query("SELECT page_id, unnest(['figure', 'lead']) AS skip FROM pages")
def ext22_skip_markers(t):
    from vellum.plans.rules.audit import skips

    c = page_corpus(t, "Labo/%s.html", "<!-- audit-skip: lead, figure --><!-- audit-skip:lead -->")
    return skips(c).select(F.regexp_extract("path", r"/(\d+)\.html", 1).cast("long").alias("page_id"), "skip")


@query(f"SELECT doc_id, string_agg(text || chr(10), '' ORDER BY nr) AS markdown FROM ({LINES_SQL}) WHERE trim(text) <> '' GROUP BY 1")
def ext26_docx_markdown(t):
    from vellum.sources.office import read_docx

    blocks = read_docx(t.documents.select("doc_id", docx_udf("text").alias("content")), "doc_id")
    return feedback.docx_markdown(feedback.without_cover(blocks, "doc_id"), "doc_id").where("markdown <> ''")


# ---------------------------------------------------------------- joins, aggregates, windows


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j2_left_outer(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j3_orphans(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""WITH p AS (SELECT page_id, lower(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '')) AS path FROM pages)
SELECT DISTINCT a.page_id FROM p a JOIN p b ON b.page_id = a.page_id + 1 JOIN p c ON c.path = b.path AND c.page_id <> a.page_id""")
def j5_links_to_other_pages(t):
    """Each page gets a link to the next page's path; links to any other page count, those to itself do not."""
    p = paths(t).select(F.col("page_id").alias("to"), F.lower("path").alias("low"))
    extra = t.pages.join(p.select((F.col("to") - 1).alias("page_id"), "low"), "page_id").select("page_id", F.concat(F.lit('<a href="'), "low", F.lit('">')).alias("html"))
    anchors = t.pages.select("page_id", "html").unionByName(extra).select("page_id", F.explode(tx.every("html", r'<a href="([^"]+)"')).alias("href"))
    return anchors.withColumn("low", F.lower("href")).join(p, "low").where("to <> page_id").select("page_id").distinct()


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 1")
def j7_ambiguous_packages(t):
    return reconcile.at_most_one(t.supplier, "s_nationkey", "s_suppkey").select("s_nationkey", "n")


@query("SELECT o_orderkey AS code FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j13_unknown_codes(t):
    return t.orders.join(t.customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("o_orderkey").alias("code"))


@query("SELECT c_custkey::VARCHAR AS code, c_name || '!' AS naam, c_name AS known FROM customer WHERE c_acctbal < 0")
def j14_name_mismatch(t):
    code = F.col("c_custkey").cast("string").alias("code")
    sheet = t.customer.select(code, F.concat("c_name", F.when(F.col("c_acctbal") < 0, "!").otherwise("")).alias("naam"))
    return answers.name_mismatches(sheet, t.customer.select(code, F.col("c_name").alias("name")))


@query("""SELECT conv_id, turn, turn AS page FROM conversations QUALIFY min(turn) OVER (PARTITION BY conv_id, text) = turn AND count(*) OVER (PARTITION BY conv_id, text) = 1
AND NOT EXISTS (SELECT 1 FROM conversations c2 WHERE c2.conv_id = conversations.conv_id AND c2.turn <> conversations.turn AND contains(c2.text, conversations.text))""")
def j19_forward_match(t):
    """Each turn found on its own page, in order, where no other turn of the conversation holds its text."""
    c = t.conversations
    inside = c.alias("a").join(c.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") != F.col("b.turn")) & F.col("b.text").contains(F.col("a.text"))).select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn")).distinct()
    got = sequence.forward_match(c.select("conv_id", "turn", F.col("text").alias("h")), c.select("conv_id", F.col("turn").alias("page"), F.col("text").alias("t")), ["conv_id"], "turn", "h", "page", "t")
    return got.join(inside, ["conv_id", "turn"], "left_anti").select("conv_id", "turn", long("page").alias("page"))


@query("SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON lower(r_name) = lower(CASE n_regionkey WHEN 0 THEN 'africa' WHEN 1 THEN 'America' ELSE 'none' END)")
def j22_lower_keys(t):
    code = F.when(F.col("n_regionkey") == 0, "africa").when(F.col("n_regionkey") == 1, "America").otherwise("none")
    return t.nation.withColumn("k", F.lower(code)).join(t.region.withColumn("k", F.lower("r_name")), "k", "left").select("n_nationkey", "r_name")


@query("SELECT DISTINCT p_size FROM part WHERE p_size NOT IN (SELECT l_linenumber FROM lineitem)")
def j25_unknown_numbers(t):
    return t.part.select("p_size").distinct().join(t.lineitem.select(F.col("l_linenumber").alias("p_size")), "p_size", "left_anti")


@query(f"SELECT doc_id, nr, 1::BIGINT AS n_correct FROM ({QUESTIONS_SQL})")
def agg2_correct_choices(t):
    return assemble.question_rows(line_questions(t)).select(F.col("path").cast("long").alias("doc_id"), long("nr").alias("nr"), long("n_correct").alias("n_correct"))


@query("SELECT count(*) FILTER (WHERE l_quantity <= 40 AND l_discount > 0.02) AS copied, count(*) FILTER (WHERE l_quantity <= 40 AND l_discount <= 0.02) AS reused, count(*) FILTER (WHERE l_quantity > 40) AS skipped FROM lineitem")
def agg12_import_totals(t):
    from vellum.sources.package import import_totals

    return import_totals(t.lineitem.select((F.col("l_discount") <= 0.02).alias("reused"), F.when(F.col("l_quantity") > 40, "too large").alias("reason")))


@query("""SELECT conv_id::VARCHAR AS code, count(*) FILTER (WHERE role = 'user') AS n_code, 2 * count(*)::BIGINT AS n_images, false AS empty FROM conversations GROUP BY 1""")
def agg13_report_counts(t):
    parts = t.conversations.select(F.col("conv_id").cast("string").alias("code"), F.col("turn").alias("place"), F.when(F.col("role") == "user", "code").otherwise("docx").alias("kind"), F.col("role").alias("name"), "text", F.lit(2).alias("n_images"))
    out = feedback.reports(parts, privacy.name_patterns(["Nobody Known"]), ["x"])
    return out.select("code", "n_code", "n_images", "empty")


@query("""SELECT user_id, ts, event_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS number FROM events""")
def win3_running_number(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("user_id", "ts", "event_id", long(F.sum((F.col("event_type") == "view").cast("int")).over(w)).alias("number"))


@query("SELECT 'n' || n_nationkey AS id, r_regionkey = 0 AS hidden, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def win10_inherited(t):
    return menu.rows(menu.flatten(nation_menus(t))).where("kind = 'topic'").select("id", "hidden", "name")


@query("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (WHERE rn <= 3) AS shown, greatest(count(*) - 3, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1")
def srt7_first_and_rest(t):
    rows = t.orders.withColumn("txt", F.col("o_orderkey").cast("string"))
    return worklist.first_and_rest(rows, ["o_custkey"], ["o_orderkey"], "txt", 3).select("o_custkey", F.array_join("shown", ",").alias("shown"), "more")


@query("SELECT page_id, host FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1")
def srt9_first_of_group(t):
    p = t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return sequence.first_rows(p, ["host"], ["page_id"]).select("page_id", "host")


# ---------------------------------------------------------------- sets


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set1_union(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set2_intersect(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set3_difference(t):
    return t.part.select(F.col("p_partkey").alias("k")).exceptAll(t.lineitem.where("l_quantity > 45").select("l_partkey").distinct())


@query("SELECT l_orderkey, bool_and(l_partkey <= 1000) AS inside FROM lineitem GROUP BY 1")
def set4_subset(t):
    allowed = t.part.where("p_partkey <= 1000").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("ok"))
    return t.lineitem.select("l_orderkey", "l_partkey").distinct().join(allowed, "l_partkey", "left").groupBy("l_orderkey").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("inside"))


# ---------------------------------------------------------------- scalars


@query("SELECT doc_id, regexp_replace(source, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe FROM documents")
def str6_safe_names(t):
    return t.documents.select("doc_id", tx.safe_name("source").alias("safe"))


@query("SELECT doc_id, true AS same FROM documents")
def str7_same_text(t):
    return t.documents.select("doc_id", tx.same_text(F.regexp_replace("text", " ", "  \n"), F.col("text")).alias("same"))


@query("SELECT p_partkey, 'Map ' || p_name AS code FROM part")
def str11_generics(t):
    code = F.concat(F.lit("Map<String, List<int[]>> "), "p_name")
    return t.part.select("p_partkey", kernels.vectorised(kernels.without_generics, "string")(code).alias("code"))


@query("SELECT doc_id, len(trim(regexp_replace(text, '\\s+', '', 'g'))) = 0 AS nothing FROM documents")
def str12_invisible(t):
    return t.documents.select("doc_id", tx.invisible("text").alias("nothing"))


@query("SELECT page_id, 'id=\"p' || page_id || '-a\" href=\"#p' || page_id || '-a\"' AS html FROM pages")
def str14_prefixed_ids(t):
    return t.pages.select("page_id", tx.prefix_ids(F.lit('id="a" href="#a"'), F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("html"))


@query("""WITH d AS (SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM documents)
SELECT doc_id, md5('<p>a</p><pre>' || t || '</pre><pre><code>b</code></pre> <pre><code>c</code></pre>') AS h FROM d WHERE t <> ''""")
def str15_code_blocks(t):
    """Each document's lines as a block that was cut into lines, beside whole blocks, which stay."""
    cut = F.transform(F.split(tx.escape("text"), "\n", -1), lambda x: F.concat(F.lit("\n <code>"), x, F.lit("</code>")))
    c = F.concat(F.lit('<p>a</p><pre> <code class="x">'), F.array_join(cut, ""), F.lit("\n</code></pre><pre><code>b</code></pre> <pre><code>c</code></pre>"))
    rows = t.documents.where("text <> ''").withColumn("c", c)
    return rewrite.code_block_repairs(rows, "doc_id", "c").select("doc_id", F.md5(F.col("c").cast("binary")).alias("h"))


@query("SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS vals FROM orders")
def str18_row_values(t):
    return t.orders.select("o_orderkey", F.array_join(tx.row_values(F.concat("o_orderstatus", F.lit(" | "), "o_orderpriority")), "|").alias("vals"))


@query("SELECT o_orderkey, o_orderstatus AS label, o_orderpriority AS value FROM orders")
def str19_label_values(t):
    return t.orders.select("o_orderkey", tx.label_value(F.concat("o_orderstatus", F.lit(":  "), "o_orderpriority", F.lit(" "))).alias("x")).select("o_orderkey", "x.label", "x.value")


@query("SELECT n_nationkey, chr(97 + n_nationkey::INT) AS letter FROM nation")
def str20_letters(t):
    return t.nation.select("n_nationkey", tx.letter(F.col("n_nationkey")).alias("letter"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS bare FROM customer")
def pth2_bare_paths(t):
    p = F.concat(F.lit("a/"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("./"), "c_name")
    return t.customer.select("c_custkey", (tx.fold_path(p) == p).alias("bare"))


@query("SELECT c_custkey, 'a-b-' || c_custkey || '-sheet.pdf' AS derived, c_custkey::VARCHAR AS stem, '.html' AS ext, 'a/b' AS folder FROM customer")
def pth4_derived_names(t):
    p = F.concat(F.lit("a/b/"), F.col("c_custkey").cast("string"), F.lit(".HTML"))
    derived = F.concat(F.replace(F.regexp_replace(p, r"\.[^.]*$", ""), F.lit("/"), F.lit("-")), F.lit("-sheet.pdf"))
    return t.customer.select("c_custkey", derived.alias("derived"), tx.stem(p).alias("stem"), tx.extension(p).alias("ext"), tx.parent(p).alias("folder"))


@query("SELECT c_custkey, 'k/a b+' || c_custkey || '.html' AS path FROM customer")
def pth6_hrefs(t):
    from vellum.sources.package import normal_href

    href = F.concat(F.lit("./k\\a%20b+"), F.col("c_custkey").cast("string"), F.lit(".html"))
    return t.customer.select("c_custkey", kernels.vectorised(normal_href, "string")(href).alias("path"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey::BIGINT AS width, l_suppkey::BIGINT AS height FROM lineitem")
def mth2_image_sizes(t):
    """PNG headers made of two numbers of each line, and read back."""
    be = lambda c: F.unhex(F.lpad(F.hex(F.col(c).cast("long")), 8, "0"))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), be("l_partkey"), be("l_suppkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tx.png_size(png).alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", long("s.width").alias("width"), long("s.height").alias("height"))


@query("SELECT r_name, '1. ' || r_name AS title FROM region WHERE r_regionkey = 2")
def jsn5_select_module(t):
    mods = menu.rows(menu.flatten(nation_menus(t))).where("kind = 'module'").select(F.col("path").alias("r_name"), "id", "title")
    return assemble.select_modules(mods, "r2").select("r_name", "title")


@query("SELECT c_custkey, c_custkey % 3 = 0 AS same FROM customer")
def arr2_ordered_lists(t):
    a, b = F.array(F.lit(1), F.lit(2)), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(1)))
    return t.customer.select("c_custkey", (a == b).alias("same"))


# ---------------------------------------------------------------- rewrites, plans, assembly


def _frame(page_id: str, kind: int) -> tuple[str, str]:
    """A frame and what becomes of it; page_id stands for the page's own."""
    link = lambda label, url, title="": f'<div class="pdf-note"><strong>{label}.</strong>{title}<br><a href="{url}">{url}</a></div>'
    return [
        (f'<iframe width="3" src="https://www.youtube.com/embed/v{page_id}?rel=0" title="A &amp; B"></iframe>', link("Video", f"https://www.youtube.com/watch?v=v{page_id}", " A &amp; B")),
        (f"<IFRAME src='https://www.youtube-nocookie.com/embed/n{page_id}' title='YouTube video player'>no <b>frames</b></IFRAME>", link("Video", f"https://www.youtube.com/watch?v=n{page_id}")),
        (f'<iframe src="/d2l/common/{page_id}"></iframe>', TEXTS.on_platform),
        (f'<iframe src="https://x.panopto.eu/e?id={page_id}&amp;t=1"></iframe>', link("Video", f"https://x.panopto.eu/e?id={page_id}&amp;t=1")),
        (f'<iframe title="Map" src="https://e.example/{page_id}">', link("Embedded page", f"https://e.example/{page_id}", " Map")),
        (f'<!-- <iframe src="https://e.example/{page_id}"></iframe> -->', f'<!-- <iframe src="https://e.example/{page_id}"></iframe> -->'),
    ][kind]


@query("SELECT page_id, md5(html || CASE page_id % 6 " + " ".join(f"WHEN {k} THEN replace('{_frame('@', k)[1]}', '@', page_id::VARCHAR)" for k in range(6)) + " END) AS h FROM pages")
def rw4_frames(t):
    """Frames of six kinds behind each page: videos with and without titles, the platform's own, one that is never closed, one in a comment."""
    n, frame = F.col("page_id").cast("string"), F.lit(None)
    for k in range(6):
        frame = F.when(F.col("page_id") % 6 == k, F.replace(F.lit(_frame("@", k)[0]), F.lit("@"), n)).otherwise(frame)
    return t.pages.select("page_id", F.md5(assemble.frames_to_links(F.concat("html", frame)).cast("binary")).alias("h"))


@query("""SELECT page_id, md5(html || CASE page_id % 3 WHEN 0 THEN '<img src="img/' || page_id || '.png" alt="A">' WHEN 1 THEN '<div class="pdf-missing-img"><strong>Image missing</strong><br>A &lt;' || page_id || '&gt;</div>' ELSE '<div class="pdf-missing-img"><strong>Image missing</strong><br>image missing</div>' END || '<img src="https://e.example/x.png"><img src="data:x">') AS h,
CASE WHEN page_id % 3 > 0 THEN 'img/' || page_id || '.png' END AS missing FROM pages""")
def rw5_images(t):
    """An image behind each page, there for a third of them, with and without alternative text; remote ones stay."""
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 3
    alt = F.when(kind == 0, ' alt="A"').when(kind == 1, F.concat(F.lit(' alt="A &lt;'), n, F.lit('>"'))).otherwise("")
    pages = t.pages.select("page_id", F.concat(F.lit("p/"), n, F.lit(".html")).alias("path"), F.concat("html", F.lit('<img src="../img/'), n, F.lit('.png"'), alt, F.lit('><img src="https://e.example/x.png"><img src="data:x">')).alias("html"))
    there = t.pages.where(kind == 0).select(F.concat(F.lit("img/"), n, F.lit(".png")).alias("path"))
    out = rewrite.images_or_placeholder(pages, there)
    return out.select("page_id", F.md5(F.col("html").cast("binary")).alias("h"), F.element_at("missing", 1).alias("missing"))


@query(r"""WITH b AS (SELECT page_id, regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) AS body FROM pages),
p AS (SELECT page_id, '<h1 class="t">T</h1>' || chr(10) || CASE page_id % 3 WHEN 0 THEN '<p>intro <b>x</b></p>' WHEN 1 THEN '<div><p>stays</p></div>' ELSE '' END || '<div class="download-container"><p>d</p><ul><li><a href="y.pdf">y</a></li></ul>' || chr(10) || '</div>' || body AS romp FROM b),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(romp, '(?s)<script\b.*?</script>', '', 'g'), '(?s)<h1[^>]*>.*?</h1>\s*(<p\b[^>]*>.*?</p>)?', ''), '(?s)<div class="download-container">.*?</ul>\s*</div>', '', 'g'), '(?s)<a\b[^>]*>(.*?)</a>', '\1', 'g') AS html FROM p)
SELECT page_id, CASE WHEN page_id % 7 > 1 THEN md5(html) END AS h, CASE page_id % 7 WHEN 0 THEN 'no body' WHEN 1 THEN 'no h1' END AS error FROM c""")
def rw7_printable(t):
    """Each page as a sheet: with heading, with and without intro, with downloads; some without body or heading."""
    kind, seventh = F.col("page_id") % 3, F.col("page_id") % 7
    intro = F.when(kind == 0, "<p>intro <b>x</b></p>").when(kind == 1, "<div><p>stays</p></div>").otherwise("")
    head = F.concat(F.when(seventh == 1, "").otherwise('<h1 class="t">T</h1>\n'), intro, F.lit('<div class="download-container"><p>d</p><ul><li><a href="y.pdf">y</a></li></ul>\n</div>'))
    body = F.regexp_extract("html", "(?is)<body[^>]*>(.*)</body>", 1)
    plain = F.when(seventh == 1, F.regexp_replace(body, "(?is)<h1\\b[^>]*>.*?</h1>", "")).otherwise(body)
    sheet = F.concat(F.lit("<html><head><title>a <h1></title></head>"), F.when(seventh == 0, "<main>").otherwise("<body class='x'>"), head, plain, F.when(seventh == 0, "</main>").otherwise("</body>"), F.lit("</html>"))
    got = t.pages.select("page_id", assemble.printable(sheet).alias("p"))
    return got.select("page_id", F.md5(F.col("p.html").cast("binary")).alias("h"), "p.error")


@query("""WITH c AS (SELECT *, c_custkey % 4 AS k, '## S' || c_custkey AS head, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS note FROM customer),
s AS (SELECT c_nationkey, c_custkey, c_acctbal < 0 AND k <> 1 AS changed, head || chr(10) || 'old  ' || c_name || chr(10) || CASE WHEN note <> '' THEN 'Voor de lector: ' || note || chr(10) ELSE '' END AS old,
  head || chr(10) || chr(10) || CASE WHEN k = 0 THEN '' ELSE 'new' || chr(10) || 'text' || chr(10) || CASE WHEN note <> '' THEN chr(10) ELSE '' END END || CASE WHEN k = 0 THEN 'Voor de lector: ' || trim('De lector stuurde niets. ' || note) || chr(10) WHEN note <> '' THEN 'Voor de lector: ' || note || chr(10) ELSE '' END || chr(10) AS new FROM c)
SELECT c_nationkey, md5('# T' || chr(10) || string_agg(CASE WHEN changed THEN new ELSE old END, '' ORDER BY c_custkey)) AS h, count(*) FILTER (WHERE changed) AS n FROM s GROUP BY 1""")
def rw8_written_back(t):
    """Proposals of a nation's customers; those in debt get a new text, an empty one, or the old one but for white space; all others stay byte for byte."""
    code, k = F.concat(F.lit("S"), F.col("c_custkey").cast("string")), F.col("c_custkey") % 4
    note = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Voor de lector: "), "c_mktsegment", F.lit("\n"))).otherwise("")
    files = t.customer.withColumn("b", F.concat(F.lit("## "), code, F.lit("\nold  "), "c_name", F.lit("\n"), note)).groupBy("c_nationkey").agg(F.concat(F.lit("# T\n"), sequence.text_in_order("b", ["c_custkey"])).alias("text"))
    new = t.customer.where("c_acctbal < 0").select(code.alias("code"), F.when(k == 0, "").when(k == 1, F.concat(F.lit("old "), "c_name")).otherwise(" new\r\ntext ").alias("proposal"))
    out = answers.written_back(files, new, "c_nationkey")
    return out.select("c_nationkey", F.md5(F.col("text").cast("binary")).alias("h"), long(F.size("changed")).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'keep' WHEN o_custkey % 2 = 0 THEN 'replace' ELSE 'keep-with-warning' END AS what FROM orders")
def rcn4_content_plan(t):
    plan = reconcile.content_plan(F.lit(3), F.when(F.col("o_custkey") % 2 == 0, 0).otherwise(2), F.col("o_orderstatus") == "F")
    return t.orders.select("o_orderkey", plan.alias("what"))


@query("SELECT c_custkey AS student_id, CASE WHEN c_acctbal < 0 THEN 'adjusted' ELSE 'proposal' END AS kind, CASE WHEN c_acctbal < 0 THEN 'x' ELSE c_name END || chr(10) || chr(10) || 'F' AS text FROM customer")
def rcn8_publish(t):
    code = F.col("c_custkey").cast("string").alias("code")
    review = t.customer.select(code, F.col("c_name").alias("voorstel"), F.when(F.col("c_acctbal") < 0, "x").otherwise(F.col("c_name")).alias("feedback"))
    return feedback.publish(review, t.customer.select(code, F.col("c_custkey").alias("student_id")), "F").select("student_id", "kind", "text")


@query("""SELECT c_custkey, 'grades' AS object, unnest(['other', 'score']) AS field, unnest([c_name, c_mktsegment]) AS value FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'cover', 'text', c_mktsegment FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, NULL, 'segment', c_mktsegment FROM customer WHERE c_acctbal < 0""")
def rcn3_settings_plan(t):
    """A field, an object that goes whole with what else it has, and one of which only changes go."""
    old = F.when(F.col("c_acctbal") < 0, "x").otherwise(F.col("c_mktsegment"))
    one = lambda o, f, v: F.struct(F.lit(o).cast("string").alias("object"), F.lit(f).alias("field"), v.alias("value"), F.lit("string").alias("kind"))
    side = lambda v, rest: t.customer.select("c_custkey", F.explode(F.array(one(None, "segment", v), one("grades", "score", v), one("cover", "text", v), *rest)).alias("s")).select("c_custkey", "s.*")
    want = side(F.col("c_mktsegment"), [])
    have = side(old, [one("grades", "other", F.col("c_name")), one("cover", "size", F.col("c_name"))])
    plan = reconcile.settings_plan(want, have, ["c_custkey"], ["cover"])
    return plan.select("c_custkey", "object", F.explode("body").alias("field", "value"))


@query("SELECT n_regionkey, count(*) AS n_topics FROM nation GROUP BY 1")
def snk5_worklist(t):
    topics = t.nation.select(F.col("n_regionkey").alias("path"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("title"), F.array(F.lit("M"), F.col("n_regionkey").cast("string")).alias("module"), F.lit(False).alias("hidden"), F.lit("page").alias("kind"))
    return worklist.worklist(topics).select(F.col("path").alias("n_regionkey"), long(F.regexp_count("markdown", F.lit(r"- \[ \]"))).alias("n_topics"))


@query("SELECT r_name, n_name AS title, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def exp1_item_list(t):
    rows = menu.rows(menu.flatten(nation_menus(t)))
    return assemble.item_list(rows).select(F.regexp_replace("module", r"^1\. ", "").alias("r_name"), "title", long("place").alias("place"))


@query(f"SELECT doc_id, nr, 'choices' AS kind FROM ({QUESTIONS_SQL})")
def exp5_render_plan(t):
    pages = line_questions(t).select("path", F.concat(F.lit("<!-- verslag "), F.col("html"), F.lit(" -->")).alias("html"))
    return worklist.render_plan(pages).select(F.col("path").cast("long").alias("doc_id"), long("nr").alias("nr"), "kind")


@query("SELECT p_partkey, '<div class=\"vraag\">' || p_name || '</div><div class=\"antwoord\">' || p_brand || '</div>' AS html FROM part")
def exp6_answer_key(t):
    qs = t.part.select("p_partkey", F.col("p_name").alias("stem"))
    matched = answers.match_answers(qs, t.part.select("p_partkey", F.col("p_brand").alias("body")), ["p_partkey"])
    return worklist.answer_key(qs, matched, ["p_partkey"])


@query("SELECT conv_id AS path, string_agg(text, '' ORDER BY turn) AS html FROM conversations GROUP BY 1")
def imp8_nested_lists(t):
    """Turns as list items of two levels; the markup around them is taken off again."""
    items = t.conversations.select(F.col("conv_id").alias("path"), F.col("turn").alias("ord"), (F.col("role") == "assistant").cast("int").alias("level"), "text")
    out = assemble.nested_list(items, ["path"])
    return out.select("path", tx.decode_basic(F.regexp_replace("html", "</?(?:ul|li)>", "")).alias("html"))
