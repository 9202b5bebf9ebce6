"""Queries of the engine's operators over the driver's tables, with DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.tokens import TEXTS
from vellum.operators import assemble, menu, privacy, reconcile, runs, sequence
from vellum.operators.contains import occurring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Input tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register fn(tables) under its name."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


URL = r'(?:href|src)\s*=\s*"([^"]+)"'
LINKS_SQL = r"""links AS (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)\s*=\s*"([^"]+)"', 1)) AS href FROM pages),
paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') AS path FROM pages)"""


def links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(tx.every("html", URL)).alias("href"))


def paths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+", ""), "[?#].*$", "").alias("path"))


# ---------------------------------------------------------------- extraction


@query(f"WITH {LINKS_SQL} SELECT * FROM links")
def ext1_links(t):
    return links(t)


@query(r"""SELECT page_id, nr, unnest(regexp_extract_all(line, '(?:href|src)\s*=\s*"([^"]+)"', 1)) AS href FROM
(SELECT page_id, unnest(string_split(html, chr(10))) AS line, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS nr FROM pages)""")
def ext4_line_numbers(t):
    return t.pages.select("page_id", F.explode(tx.numbered("html", URL, 1)).alias("m")).select("page_id", long("m.nr").alias("nr"), F.col("m.text").alias("href"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS comment FROM pages")
def ext3_comments(t):
    return t.pages.select("page_id", F.explode(tx.every("html", tx.COMMENT)).alias("comment"))


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS nr FROM documents")
def ext5_lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("doc_id", "line", long(F.col("pos") + 1).alias("nr"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM pages""")
def ext13_titles(t):
    return t.pages.select("page_id", tx.title("html").alias("title"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) AS body FROM pages""")
def ext18_bodies(t):
    return t.pages.select("page_id", F.regexp_extract("html", r"(?is)<body[^>]*>(.*)</body>", 1).alias("body"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS plain FROM pages""")
def str1_plain_text(t):
    return t.pages.select("page_id", F.md5(tx.strip_tags("html").cast("binary")).alias("plain"))


@query(r"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE len(text) > 0),
l AS (SELECT doc_id, unnest(ls) AS body, unnest(range(1, len(ls) + 1)) AS nr FROM x)
SELECT doc_id, nr, body FROM l""")
def ext9_questions(t):
    """Lines of documents as questions of a numbered list, read back by the depth counter."""
    body = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("<li>"), tx.escape(x), F.lit("</li>"))), "")
    pages = t.documents.where(F.length("text") > 0).select("doc_id", F.concat(F.lit('<ol class="vragen">'), body, F.lit("</ol>")).alias("html"))
    from vellum.functions.kernels import question_lists_udf

    rows = pages.select("doc_id", F.explode(question_lists_udf("html")).alias("l")).select("doc_id", F.col("l.begin").alias("begin"), F.posexplode("l.items").alias("pos", "i"))
    return rows.select("doc_id", long(F.col("begin") + F.col("pos")).alias("nr"), F.regexp_replace(F.regexp_replace(F.regexp_replace("i.body", "&lt;", "<"), "&gt;", ">"), "&amp;", "&").alias("body"))


# ---------------------------------------------------------------- scalar functions


@query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
regexp_replace(url, '[^A-Za-z0-9_-]', '-', 'g') AS identifier FROM pages""")
def str3b_slugs(t):
    return t.pages.select("page_id", tx.slug("url").alias("slug"), tx.identifier("url").alias("identifier"))


@query(r"""SELECT c_custkey, lower(regexp_replace(c_name, '([^#])([A-Z0-9])', '\1-\2', 'g')) AS kebab FROM (SELECT c_custkey, regexp_replace(c_name, '[0-9].*$', '') AS c_name FROM customer)""")
def str4_kebab(t):
    return t.customer.select("c_custkey", tx.kebab(F.regexp_replace("c_name", "[0-9].*$", "")).alias("kebab"))


@query("""SELECT doc_id, CASE WHEN len(t) <= 60 THEN t ELSE regexp_replace(substring(t, 1, 58), '\\s+\\S*$', '') || '...' END AS short
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def str17_truncate(t):
    return t.documents.select("doc_id", tx.truncate(tx.squeeze("text"), 60).alias("short"))


@query("SELECT o_orderkey, (year(o_orderdate) - CASE WHEN month(o_orderdate) >= 9 THEN 0 ELSE 1 END)::BIGINT AS year FROM orders")
def dte1_academic_year(t):
    return t.orders.select("o_orderkey", long(tx.academic_year("o_orderdate")).alias("year"))


@query("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hsh1_hashes(t):
    return t.documents.select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query(f"""WITH {LINKS_SQL} SELECT page_id, href, CASE WHEN href LIKE '/%' THEN 'a/x' || href ELSE 'a/x/other' END AS target FROM (SELECT page_id, regexp_replace(regexp_replace(href, '[?#].*$', ''), '[^/a-z0-9]+', '-', 'g') AS href FROM links)""")
def pth1_targets(t):
    """Every link, its odd signs replaced, as a reference out of a/b/c.html with steps up and a fragment: resolved and folded."""
    plain = links(t).withColumn("href", F.regexp_replace(F.regexp_replace("href", "[?#].*$", ""), "[^/a-z0-9]+", "-"))
    up = F.when(F.col("href").startswith("/"), F.concat(F.lit("../x/./y/.."), "href")).otherwise("../x/y/../other")
    return plain.withColumn("target", tx.local_target(F.lit("a/b/c.html"), F.concat(up, F.lit("?q=1#f"))))


@query("SELECT doc_id, source FROM documents WHERE source LIKE 'src1%'")
def flt6_glob(t):
    return t.documents.where(tx.any_glob("source", ["src1*"])).select("doc_id", "source")


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n_p, len(regexp_extract_all(html, '<li>')) AS n_li, len(html) - len(replace(html, chr(10), '')) AS n_newlines FROM pages""")
def agg3_counts(t):
    return t.pages.select("page_id", long(F.regexp_count("html", F.lit("<p>"))).alias("n_p"), long(F.regexp_count("html", F.lit("<li>"))).alias("n_li"), long(tx.newlines(F.col("html"))).alias("n_newlines"))


# ---------------------------------------------------------------- joins


@query(f"WITH {LINKS_SQL} SELECT page_id, href FROM links WHERE href NOT IN (SELECT path FROM paths WHERE path IS NOT NULL)")
def j1_dangling_links(t):
    return links(t).join(paths(t).select(F.col("path").alias("href")).distinct(), "href", "left_anti").select("page_id", "href")


@query(f"""WITH {LINKS_SQL}, k AS (SELECT DISTINCT path FROM paths UNION SELECT DISTINCT upper(href) FROM links WHERE len(href) < 5 AND regexp_full_match(href, '[ -~]+'))
SELECT DISTINCT l.href, k.path FROM links l JOIN k ON lower(l.href) = lower(k.path) AND l.href <> k.path""")
def j1b_case_mismatch(t):
    ls = links(t)
    known = paths(t).select("path").union(ls.where((F.length("href") < 5) & F.col("href").rlike("^[ -~]+$")).select(F.upper("href"))).distinct()
    return ls.join(known, (F.lower("href") == F.lower("path")) & (F.col("href") != F.col("path"))).select("href", "path").distinct()


@query(f"""WITH {LINKS_SQL} SELECT l.page_id, l.href, CASE WHEN p.path IS NULL THEN 'missing' WHEN p.page_id = l.page_id THEN 'self' ELSE 'page' END AS outcome
FROM links l LEFT JOIN (SELECT path, min(page_id) AS page_id FROM paths GROUP BY path) p ON l.href = p.path""")
def j27_link_outcome(t):
    p = paths(t).groupBy("path").agg(F.min("page_id").alias("p_id"))
    out = links(t).join(p, F.col("href") == F.col("path"), "left")
    return out.select("page_id", "href", F.when(F.col("path").isNull(), "missing").when(F.col("p_id") == F.col("page_id"), "self").otherwise("page").alias("outcome"))


@query("""SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, CASE WHEN s.s_nationkey IS NULL THEN 'only customers' WHEN c.c_nationkey IS NULL THEN 'only suppliers' ELSE 'both' END AS side
FROM (SELECT DISTINCT c_nationkey FROM customer) c FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier) s ON c.c_nationkey = s.s_nationkey""")
def j4_full_outer(t):
    c, s = t.customer.select(F.col("c_nationkey").alias("nation"), F.lit(1).alias("c")).distinct(), t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit(1).alias("s")).distinct()
    return c.join(s, "nation", "full_outer").select("nation", F.when(F.col("s").isNull(), "only customers").when(F.col("c").isNull(), "only suppliers").otherwise("both").alias("side"))


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM conversations),
s AS (SELECT DISTINCT conv_id, turn, array_to_string(ws[i:i+2], ' ') AS g FROM (SELECT conv_id, turn, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))
SELECT DISTINCT a.conv_id, a.turn AS turn_a, b.turn AS turn_b FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.g = b.g AND a.turn < b.turn""")
def j6_shared_runs(t):
    texts = t.conversations.select("conv_id", "turn", tx.every(F.lower("text"), "[a-z]+", 0).alias("words"))
    return runs.shared_runs(texts, "conv_id", ["turn"], "words", 3).select("conv_id", F.col("a.turn").alias("turn_a"), F.col("b.turn").alias("turn_b"))


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), lower(n_name)))")
def j24_substring_anti(t):
    """The names go to the texts, which are read once; names that occur come back."""
    names = t.nation.select("n_nationkey", F.lower("n_name").alias("name"))
    return names.join(occurring(names, t.documents.select(F.lower("text").alias("text"))), "name", "left_anti").select("n_nationkey")


@query("""SELECT e.event_id, v.event_id AS view_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v
ON e.user_id = v.user_id AND e.ts >= v.ts WHERE e.event_type <> 'view'""")
def j18_as_of(t):
    views = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("view_id"))
    rest = t.events.where("event_type <> 'view'").select("user_id", "ts", "event_id")
    return sequence.as_of(rest, views, ["user_id"], "ts", "start", ["view_id"]).select("event_id", "view_id")


@query("""SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity BETWEEN p_size AND p_size + 5""")
def j20_range_join(t):
    points = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("at"))
    ranges = t.part.select("p_partkey", F.col("p_size").alias("lo"), (F.col("p_size") + 5).alias("hi"))
    return sequence.in_ranges(points, ranges, ["p_partkey"], "at", "lo", "hi", 8).select("l_orderkey", "l_linenumber", "p_partkey")


@query("""WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'view'),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'click')
SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.k, r.k) AS occurrence, l.event_id AS view_id, r.event_id AS click_id FROM l FULL JOIN r ON l.user_id = r.user_id AND l.k = r.k""")
def j16_kth_to_kth(t):
    one = lambda kind, name, at: t.events.where(F.col("event_type") == kind).select("user_id", F.col("ts").alias(at), F.col("event_id").alias(name))
    out = sequence.kth_to_kth(one("view", "view_id", "t1"), one("click", "click_id", "t2"), "user_id", ["t1", "view_id"], ["t2", "click_id"])
    return out.select("user_id", long("occurrence").alias("occurrence"), "view_id", "click_id")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS outer_heading,
last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id, g ORDER BY turn ROWS UNBOUNDED PRECEDING) AS inner_heading
FROM (SELECT *, count(CASE WHEN role = 'user' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def j17_nested_headings(t):
    return sequence.nested_headings(t.conversations, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).select("conv_id", "turn", "outer_heading", "inner_heading")


# ---------------------------------------------------------------- aggregations


WORDS = ["license", "version", "confidential", "und", "the", "que", "dans"]


@query(r"""SELECT DISTINCT doc_id, unnest(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z]+', '  ', 'g') || ' ', ' (license|version|confidential|und|the|que|dans) ', 1)) AS word
FROM (SELECT doc_id, regexp_replace(lower(text), '[^\x00-\x7f]', 'zz', 'g') AS text FROM documents)""")
def agg15_word_hits(t):
    from vellum.plans.rules.audit import word_hits

    return word_hits(t.documents.withColumn("text", F.lower("text")), "text", WORDS, ["doc_id"])


@query("""SELECT user_id, event_type, n, total FROM (SELECT user_id, event_type, n, sum(n) OVER (PARTITION BY user_id)::BIGINT AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rn = 1 AND total >= 4 AND n > 0.25 * total""")
def agg4_majority(t):
    return reconcile.majority(t.events, ["user_id"], "event_type", share=0.25)


@query("""SELECT l_orderkey, marked_len, other_len FROM (SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_linenumber = 1) AS marked_len, max(l_quantity) FILTER (WHERE l_linenumber <> 1) AS other_len FROM lineitem GROUP BY 1)
WHERE marked_len >= 1.15 * other_len AND marked_len - other_len >= 10""")
def agg5_longest_marked(t):
    return reconcile.longest_is_marked(t.lineitem, ["l_orderkey"], F.col("l_quantity"), F.col("l_linenumber") == 1)


@query("""SELECT c_nationkey, count(*) AS expected, count(o) AS covered, count(o) / count(*)::DOUBLE AS ratio, array_to_string(list_sort(list(c_custkey) FILTER (WHERE o IS NULL)), ',') AS uncovered
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey GROUP BY 1""")
def agg6_coverage_ratio(t):
    expected = t.customer.select("c_nationkey", "c_custkey")
    got = reconcile.coverage_ratio(expected, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_nationkey"], "c_custkey")
    return got.withColumn("uncovered", F.nullif(F.array_join(F.transform("uncovered", lambda x: x.cast("string")), ","), F.lit("")))


def nation_coverage(t):
    cov = t.orders.where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select("o_custkey").distinct()
    sources = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("o_custkey"))
    return reconcile.coverage(t.nation.select("n_nationkey", "n_name"), sources, cov, ["n_nationkey"], "o_custkey")


COVERAGE_SQL = """c AS (SELECT n_nationkey, n_name, CASE WHEN bool_or(c_custkey IS NOT NULL) IS NOT TRUE THEN 'no-source' WHEN bool_or(o IS NOT NULL) THEN 'covered' ELSE 'uncovered' END AS status
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000) ON o = c_custkey GROUP BY 1, 2)"""


@query(f"WITH {COVERAGE_SQL} SELECT * FROM c")
def j8_coverage(t):
    """With the customers of every nation."""
    return nation_coverage(t)


@query(f"WITH {COVERAGE_SQL} SELECT status, count(*) AS n FROM c GROUP BY 1")
def agg7_per_status(t):
    return nation_coverage(t).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT user_id, arg_max(k, (n, -k)) AS variant, max(n) AS n FROM (SELECT user_id, (event_id % 4)::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""")
def agg8_best_variant(t):
    per = t.events.groupBy("user_id", long(F.col("event_id") % 4).alias("variant")).agg(F.count("*").alias("n"))
    return reconcile.best_variant(per, ["user_id"], "variant", "n")


@query("""SELECT conv_id, sha256(string_agg(role || ':' || sha256(text) || chr(10), '' ORDER BY role || ':' || sha256(text) || chr(10))) AS hash FROM conversations GROUP BY 1""")
def agg10_fingerprints(t):
    parts = t.conversations.select("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return privacy.fingerprint(parts, ["conv_id"], "role", "h")


@query("""SELECT p_partkey, left(sha1(p_name), 10) AS hash FROM part""")
def agg11_item_hash(t):
    return t.part.select("p_partkey", privacy.item_hash(F.col("p_name"), F.expr("cast(array() as array<binary>)")).alias("hash"))


@query(r"""WITH s AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, string_split(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/') AS p FROM pages),
k AS (SELECT host, unnest(p) AS e, unnest(range(1, len(p) + 1)) AS i FROM s), r AS (SELECT host, count(*) AS c FROM s GROUP BY 1),
m AS (SELECT k.host, i, min(e) = max(e) AND count(*) = any_value(c) AS same, min(e) AS e FROM k JOIN r ON k.host = r.host GROUP BY k.host, i),
g AS (SELECT *, min(same::INT) OVER (PARTITION BY host ORDER BY i) AS ok FROM m)
SELECT r.host, coalesce(string_agg(g.e, '/' ORDER BY g.i), '') AS prefix FROM r LEFT JOIN g ON g.host = r.host AND g.ok = 1 GROUP BY 1""")
def agg16_common_prefix(t):
    p = t.pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.split(F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1), "/", -1).alias("p"))
    return menu.common_prefix(p, ["host"], "p").select("host", F.array_join("prefix", "/").alias("prefix"))


@query("""(SELECT k, 'only_a' AS side FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)) UNION ALL
(SELECT k, 'only_b' FROM (SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer))""")
def set5_multiset_difference(t):
    return reconcile.multiset_difference(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")))


@query("""WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT line FROM l GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, count(*) FILTER (WHERE m.line IS NULL) = 0 AS inside FROM l LEFT JOIN m ON l.line = m.line GROUP BY 1""")
def j26_division(t):
    """Documents all of whose lines occur in another document too."""
    l = t.documents.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).distinct()  # noqa: E741
    m = l.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line", F.lit(True).alias("hit"))
    return l.join(m, "line", "left").groupBy("doc_id").agg((F.count_if(F.col("hit").isNull()) == 0).alias("inside"))


# ---------------------------------------------------------------- windows


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1")
def win1_repeats(t):
    return sequence.repeats(t.documents.select("doc_id", "text"), ["text"], ["doc_id"])


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def win2_carry_forward(t):
    return sequence.carry_forward(t.conversations, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "asked").select("conv_id", "turn", "asked")


@query("""WITH x AS (SELECT conv_id, turn, role = 'user' AS ch, len(text) > 100 AS cnt, sum((role = 'user')::INT) OVER w AS g, sum((role = 'user' AND len(text) > 100)::INT) OVER w AS n,
last_value(CASE WHEN role = 'user' THEN len(text) > 100 END IGNORE NULLS) OVER w AS counts FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, CASE WHEN counts THEN n END::BIGINT AS chapter_no, CASE WHEN counts AND NOT ch THEN sum((NOT ch)::INT) OVER (PARTITION BY conv_id, g ORDER BY turn ROWS UNBOUNDED PRECEDING) END::BIGINT AS section_no FROM x""")
def win4_chapter_numbers(t):
    out = sequence.chapter_numbers(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user", F.length("text") > 100)
    return out.select("conv_id", "turn", long("chapter_no").alias("chapter_no"), long("section_no").alias("section_no"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def win5_latest_per_kind(t):
    return privacy.latest_per_kind(t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id"], "event_type", ["event_id"], "ts").select("user_id", "event_type", "event_id")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def win6_keep_first(t):
    files = t.documents.select(F.lit(1).alias("k"), "doc_id", F.col("text").cast("binary").alias("content"))
    return privacy.without_copies(files, ["k"], ["doc_id"], "content", "doc_id", F.lit(""), F.lit("")).select("doc_id")


@query("""WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer WHERE c_mktsegment = 'BUILDING'), top AS (SELECT max(n) AS m FROM k),
w AS (SELECT c_custkey, m + row_number() OVER (ORDER BY c_custkey) AS n FROM customer, top WHERE c_mktsegment <> 'BUILDING')
SELECT c_custkey, 'S' || lpad(n::VARCHAR, greatest(3, len(n::VARCHAR))::INT, '0') AS code FROM (SELECT * FROM k UNION ALL SELECT * FROM w)""")
def win7_stable_codes(t):
    code = lambda n: F.concat(F.lit("S"), F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), F.lit("0")))
    known = privacy.global_rank(t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey"), "c_custkey").select(code(F.col("rank")).alias("code"), "c_custkey")
    return privacy.stable_codes(t.customer, known, "c_custkey").select("c_custkey", "code")


@query(r"""SELECT doc_id, nr, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS nr FROM documents)
WHERE contains(lower(line), 'license') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY nr) = 1""")
def win11_first_hit(t):
    # documents without the word are dropped before they are split
    lines = t.documents.where(F.lower("text").contains("license")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.lower("line").contains("license"))
    return sequence.first_rows(lines, ["doc_id"], ["pos"]).select("doc_id", long(F.col("pos") + 1).alias("nr"), "line")


@query("""WITH x AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM x)
SELECT user_id, island::BIGINT AS island, event_type, count(*) AS n, min(event_id) AS first_id FROM y GROUP BY ALL""")
def win13_islands(t):
    out = sequence.islands(t.events, ["user_id"], ["ts", "event_id"], ["event_type"], {"n": F.count("*"), "first_id": F.min("event_id")})
    return out.withColumn("island", long("island"))


# ---------------------------------------------------------------- reconciliation


PLAN_SQL = """p AS (SELECT coalesce(c_custkey, o_custkey) AS key, CASE WHEN o_custkey IS NULL THEN 'new' WHEN c_custkey IS NULL THEN 'orphan' WHEN c_mktsegment = have THEN 'same' ELSE 'changed' END AS action
FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT o_custkey, CASE WHEN max(o_totalprice) > 300000 THEN 'BUILDING' ELSE 'MACHINERY' END AS have FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def customer_plan(t):
    """Customers in credit against what their orders say."""
    have = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.when(F.max("o_totalprice") > 300000, "BUILDING").otherwise("MACHINERY").alias("content"))
    want = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("content"))
    return reconcile.plan(want, have, "k", "content")


@query(f"WITH {PLAN_SQL} SELECT * FROM p")
def j10_plan(t):
    return customer_plan(t)


@query(f"WITH {PLAN_SQL} SELECT key, action, 0::BIGINT AS step, CASE action WHEN 'new' THEN 'post' WHEN 'changed' THEN 'delete' ELSE 'report' END AS request FROM p WHERE action <> 'same' UNION ALL SELECT key, action, 1, 'post' FROM p WHERE action = 'changed'")
def rcn1_action_plan(t):
    return reconcile.action_plan(customer_plan(t)).withColumn("step", long("step"))


@query(f"WITH {PLAN_SQL} SELECT count(*) FILTER (WHERE action = 'new') AS n_new, count(*) FILTER (WHERE action = 'changed') AS n_changed, count(*) FILTER (WHERE action IN ('new', 'changed')) = 0 AS ready FROM p")
def rcn5_ready(t):
    return reconcile.ready(customer_plan(t))


@query("""WITH w AS (SELECT l_orderkey AS o, list(l_partkey ORDER BY l_linenumber, l_partkey) AS w FROM lineitem GROUP BY 1), h AS (SELECT l_orderkey AS o, list(l_partkey ORDER BY l_partkey) AS h FROM lineitem WHERE l_quantity > 5 GROUP BY 1)
SELECT coalesce(w.o, h.o) AS l_orderkey, (SELECT count(DISTINCT x) FROM unnest(w) u(x) WHERE NOT list_contains(coalesce(h, []), x)) AS n_added,
(SELECT count(DISTINCT x) FROM unnest(coalesce(h, [])) u(x) WHERE NOT list_contains(w, x)) AS n_removed,
(SELECT count(*) FROM unnest(w) u(x) WHERE NOT list_contains(coalesce(h, []), x)) = 0 AND coalesce(h, []) <> w AS reordered FROM w LEFT JOIN h ON w.o = h.o""")
def j12_sequence_changes(t):
    order = lambda rows, by: rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda x: x["l_partkey"]).alias("ids"))
    out = reconcile.sequence_changes(order(t.lineitem, ["l_linenumber", "l_partkey"]), order(t.lineitem.where("l_quantity > 5"), ["l_partkey"]), ["l_orderkey"], "ids")
    return out.select("l_orderkey", long(F.size("added")).alias("n_added"), long(F.size("removed")).alias("n_removed"), "reordered")


@query("""WITH n AS (SELECT o_orderkey, sha256(o_orderstatus || o_orderpriority) AS h FROM orders), b AS (SELECT o_orderkey, sha256((CASE WHEN o_totalprice > 200000 THEN 'O' ELSE o_orderstatus END) || o_orderpriority) AS was FROM orders WHERE o_orderdate < DATE '1996-01-01')
SELECT n.o_orderkey, h, CASE WHEN was IS NULL THEN 'new' WHEN was <> h THEN 'changed' ELSE '' END AS status FROM n LEFT JOIN b ON n.o_orderkey = b.o_orderkey""")
def rcn7_change_status(t):
    h = lambda s: F.sha2(F.concat(s, "o_orderpriority").cast("binary"), 256)
    now = t.orders.select("o_orderkey", h(F.col("o_orderstatus")).alias("h"))
    before = t.orders.where("o_orderdate < date '1996-01-01'").select("o_orderkey", h(F.when(F.col("o_totalprice") > 200000, "O").otherwise(F.col("o_orderstatus"))).alias("h"))
    return reconcile.change_status(now, before, "o_orderkey", "h")


@query("""WITH d AS (SELECT l_orderkey AS k, v, l_linenumber AS item, l_returnflag || (v % 2) || CASE WHEN v >= 2 AND l_discount > 0.05 THEN 'x' ELSE '' END AS want FROM lineitem, (VALUES (0), (1), (2), (3)) t(v)),
e AS (SELECT l_orderkey AS k, l_linenumber AS item, l_returnflag || (l_linenumber % 2) AS have FROM lineitem WHERE l_quantity > 3),
p AS (SELECT d.k, v, count(*) FILTER (WHERE want = have) AS s, count(*) FILTER (WHERE have IS NULL) AS nw, count(*) AS c FROM d LEFT JOIN e ON d.k = e.k AND d.item = e.item GROUP BY 1, 2),
b AS (SELECT k, arg_max(v, (s, -v)) AS v FROM p GROUP BY 1), h AS (SELECT k, count(*) AS n FROM e GROUP BY 1)
SELECT p.k AS l_orderkey, p.v::BIGINT AS variant, s AS n_same, nw AS n_new, c - s - nw AS n_changed, coalesce(n, 0) - s - (c - s - nw) AS n_orphan FROM p JOIN b ON p.k = b.k AND p.v = b.v LEFT JOIN h ON h.k = p.k""")
def rcn6_staleness(t):
    variants = F.explode(F.array(*(F.lit(v).cast("long") for v, _, _ in reconcile.VARIANTS)))
    want = F.concat("l_returnflag", (F.col("variant") % 2).cast("string"), F.when((F.col("variant") >= 2) & (F.col("l_discount") > 0.05), "x").otherwise(""))
    desired = t.lineitem.withColumn("variant", variants).select("l_orderkey", "variant", F.col("l_linenumber").alias("item"), want.alias("content"))
    existing = t.lineitem.where("l_quantity > 3").select("l_orderkey", F.col("l_linenumber").alias("item"), F.concat("l_returnflag", (F.col("l_linenumber") % 2).cast("string")).alias("content"))
    return reconcile.staleness(desired, existing, ["l_orderkey"], "item", "content")


@query("SELECT event_id, k AS field, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL) WHERE json_type(props, '$.' || k) NOT IN ('OBJECT', 'NULL') AND k NOT LIKE '\\_%' ESCAPE '\\'")
def jsn4_flatten(t):
    return reconcile.flatten_settings(t.events.where("props is not null"), ["event_id"], "props").where("object is null").select("event_id", "field", "value")


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'empty' WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = trim(regexp_replace(prev, '\\s+', ' ', 'g')) THEN 'proposal' ELSE 'adjusted' END AS kind
FROM (SELECT text, CASE WHEN lang = 'en' THEN replace(text, '. ', '.  ') ELSE text || 'x' END AS prev FROM documents)) GROUP BY 1""")
def agg9_decisions(t):
    prev = F.when(F.col("lang") == "en", F.replace("text", F.lit(". "), F.lit(".  "))).otherwise(F.concat("text", F.lit("x")))
    kind, _ = reconcile.decision(prev, F.col("text"), "")
    return t.documents.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n, array_to_string(list_sort(list(c_custkey)), ',') AS ids FROM customer WHERE c_acctbal > 9000 GROUP BY 1 HAVING count(*) > 1")
def hlp2_at_most_one(t):
    return reconcile.at_most_one(t.customer.where("c_acctbal > 9000"), "c_mktsegment", "c_custkey").withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


# ---------------------------------------------------------------- assembly


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def exp2_ordered_text(t):
    return t.conversations.groupBy("conv_id").agg(sequence.text_in_order("text", ["turn"], "\n").alias("text"))


@query("""SELECT conv_id, string_agg('<li value=''' || turn || '''>' || text || '</li>', '' ORDER BY turn) AS answers FROM (SELECT *, bool_and(len(text) > 30) OVER (PARTITION BY conv_id) AS ok FROM conversations) WHERE ok GROUP BY 1""")
def rw6_all_or_nothing(t):
    rows = t.conversations.select("conv_id", F.lit(1).alias("place"), F.col("turn").alias("nr"), F.when(F.length("text") > 30, F.col("text")).alias("answer"))
    return assemble.chapters_with_answers(rows, ["conv_id"]).select("conv_id", F.regexp_replace("answers", "^<ol>|</ol>$", "").alias("answers"))


@query(rf"""WITH p AS (SELECT page_id, html || '<script>' || CASE page_id % 4 WHEN 0 THEN 'draw("</p>")' WHEN 1 THEN ' initChecklistSync( "a" ) ; ' WHEN 2 THEN chr(10) ELSE 'initChecklistSync(1); more()' END || '</script><script src="x.js">y</script>' AS html FROM pages),
a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*\bsrc="[^"]+"[^>]*>.*?</script>', '', 'g') AS html FROM p),
b AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>\s*(initChecklistSync\s*\([^)]*\)\s*;?\s*)?</script>', '', 'g') AS html FROM a)
SELECT page_id, md5(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', '{TEXTS.interactive}', 'g')) AS h FROM b""")
def rw3_without_scripts(t):
    """Scripts of four kinds behind each page's own; only those that show something leave a note."""
    kind = F.col("page_id") % 4
    body = F.when(kind == 0, 'draw("</p>")').when(kind == 1, ' initChecklistSync( "a" ) ; ').when(kind == 2, "\n").otherwise("initChecklistSync(1); more()")
    html = F.concat("html", F.lit("<script>"), body, F.lit('</script><script src="x.js">y</script>'))
    return t.pages.select("page_id", F.md5(assemble.without_scripts(html).cast("binary")).alias("h"))


@query("""SELECT o_custkey AS code, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS place FROM orders""")
def srt4_positions(t):
    from pyspark.sql import Window

    return t.orders.select(F.col("o_custkey").alias("code"), "o_orderkey", long(F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).alias("place"))


def unzipped(docs: DataFrame, archive_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, bytes of every text, packed into archives by language and hash and read back entry by entry.

    The archives' number grows with the input, so that each holds about archive_bytes at most.
    A row without text has no entry.
    """
    from vellum.sources.files import unzip

    texts = docs.where("text is not null")
    n = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // archive_bytes)
    dealt = texts.select("lang", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("bucket"), F.concat(F.lit("d/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt")).alias("n"), F.col("text").alias("b"))
    packed = dealt.repartition(n, "lang", "bucket").groupBy("lang", "bucket").agg(F.array_sort(F.collect_list(F.struct("n", "b"))).alias("x"))
    packed = packed.select("bucket", assemble.zip_udf(F.transform("x", lambda v: v["n"]), F.transform("x", lambda v: v["b"])).alias("content"))
    return unzip(packed, "bucket").select(F.regexp_extract("entry", r"d/(-?\d*)\.txt", 1).try_cast("long").alias("doc_id"), "bytes")


@query("SELECT lower(hex(encode(text))) AS raw, doc_id FROM documents WHERE text IS NOT NULL")
def src9_unzip(t):
    """All texts through archives."""
    return unzipped(t.documents).select(F.lower(F.hex("bytes")).alias("raw"), "doc_id")
