"""Rules on the menu and what it leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.corpus import Corpus
from vellum.functions import text as tx
from vellum.functions.kernels import names_parser
from vellum.operators import menu as menus
from vellum.plans.registry import any_rows, found, rule, single, union
from vellum.plans.rules.links import PLANNED, looked_up, starts_with_any

TARGETS = ("page", "file", "instructions")
#: Fields of a quiz entry, all positive whole numbers.
QUIZ_FIELDS = ("assignment_id", "deadline", "duration", "ioem")
#: Links that a menu page may hold without leaving its frame (fixed values).
NO_FRAME = ("http", "#", "mailto:", "/", "tel:", "data:", "javascript:")


def has_menu(c: Corpus):
    return any_rows(c.texts.where(c.is_own(c.conf["menu"])), "no menu")


def nodes(c: Corpus) -> DataFrame:
    """Nodes of all menus; path is the menu's."""
    return menus.rows(c.menu)


def targets(c: Corpus) -> DataFrame:
    """path, ord, kind, target from the corpus's root, and as written in the menu."""
    rows = nodes(c).where(F.col("kind").isin(*TARGETS)).select("path", "ord", "kind", F.col("target").alias("written"))
    return rows.withColumn("target", F.concat(c.course(), "written"))


@rule("menu-targets", applies=has_menu)
def menu_targets(c: Corpus) -> DataFrame:
    """Menu targets are bare paths of existing, tracked files in this case; pages are HTML.

    Not bare ends the matter; the wrong kind of file is reported beside what else is wrong.
    """
    broken = found(c.menu.where("error is not null"), F.col("error"))
    rows = looked_up(targets(c), c)
    parts = F.split("written", "/")
    bare = (F.array_join(F.filter(parts, lambda s: ~s.isin("", ".")), "/") == F.col("written")) & ~F.array_contains(parts, "..")
    say = lambda text: F.concat(F.col("kind"), F.lit(f" {text}: "), F.col("written"))
    fine = rows.where(bare)
    kind = fine.where(F.col("kind").isin("page", "instructions") & ~F.col("target").endswith(".html"))
    cause = F.when(~F.col("is_file"), "does not exist").when(~F.col("exact"), "differs in case").when(F.lit(c.has_git) & ~F.col("tracked"), "is not under version control")
    rest = fine.where(~tx.basename("target").startswith(PLANNED)).withColumn("cause", cause).where("cause is not null")
    return union(broken, found(rows.where(~bare), say("is not a bare path")), found(kind, say("is not HTML")), found(rest, F.concat(F.col("kind"), F.lit(" "), "cause", F.lit(": "), "written")))


@rule("menu-ids", applies=has_menu)
def menu_ids(c: Corpus) -> DataFrame:
    """Ids anywhere in the menu are lower-case kebab, and none occurs twice; each repeat counts."""
    ids = menus.repeated_ids(c.menu)
    return union(found(ids.where(~(F.col("is_text") & F.col("value").rlike("^[a-z0-9-]+$"))), F.concat(F.lit("id of another form: "), "value")), found(ids.where("repeat"), F.concat(F.lit("id occurs twice: "), "value")))


@rule("menu-qr", applies=has_menu)
def menu_qr(c: Corpus) -> DataFrame:
    """A code topic has a title, no other target, one known key, and a quiz of positive whole numbers."""
    topics = nodes(c).where("kind = 'topic'")
    qr = topics.where("has_qr").withColumn("v", F.try_parse_json("qr")).withColumn("shape", F.schema_of_variant("v"))
    say = lambda text, *more: F.concat(F.lit("topic "), F.coalesce("id", F.lit("?")), F.lit(f": {text}"), *more)
    is_object = F.col("shape").startswith("OBJECT")
    objects = qr.where(is_object).withColumn("m", F.expr("try_cast(try_variant_get(v, '$', 'map<string,variant>') as map<string,variant>)")).withColumn("keys", F.map_keys("m"))
    text_of = lambda k: F.expr(f"if(schema_of_variant(element_at(m, '{k}')) = 'STRING', cast(element_at(m, '{k}') as string), null)")
    own = F.filter("keys", lambda k: k.isin("dropbox", "grade"))
    unknown = F.filter("keys", lambda k: ~k.isin("dropbox", "grade", "ans"))
    dropboxes = topics.where("dropbox is not null").select("path", F.col("dropbox").alias("box")).distinct()
    each = objects.withColumn("k", F.explode(own)).withColumn("val", F.when(F.col("k") == "dropbox", text_of("dropbox")).otherwise(text_of("grade")))
    boxes = objects.withColumn("box", text_of("dropbox")).where("box is not null")
    quiz = objects.where(F.array_contains("keys", "ans")).withColumn("a", F.element_at("m", F.lit("ans"))).withColumn("a_shape", F.schema_of_variant("a"))
    fields = quiz.where(F.col("a_shape").startswith("OBJECT")).withColumn("am", F.expr("try_cast(try_variant_get(a, '$', 'map<string,variant>') as map<string,variant>)"))
    wanted = fields.withColumn("k", F.explode(F.array(*map(F.lit, QUIZ_FIELDS)))).withColumn("x", F.expr("element_at(am, k)"))
    positive = F.coalesce((F.expr("schema_of_variant(x)") == "BIGINT") & (F.expr("try_cast(x as bigint)") > 0), F.lit(False))
    return union(
        found(qr.where(F.col("title").isNull() | (F.trim("title") == "")), say("no title")),
        found(qr.where(F.size("extra_targets") > 0), say("has other targets: ", F.array_join("extra_targets", ", "))),
        found(qr.where(~is_object), say("qr is not an object")),
        found(objects.where(F.size(unknown) > 0), say("unknown field in qr: ", F.array_join(unknown, ", "))),
        found(objects.where(F.size(own) != 1), say("qr needs exactly one of dropbox and grade")),
        found(each.where(F.col("val").isNull() | (F.trim("val") == "")), say("a text is wanted in qr: ", F.col("k"))),
        found(boxes.join(dropboxes, ["path", "box"], "left_anti"), say("no such dropbox: ", F.col("box"))),
        found(quiz.where(~F.col("a_shape").startswith("OBJECT")), say("the quiz is not an object")),
        found(fields.withColumn("k", F.explode(F.map_keys("am"))).where(~F.col("k").isin(*QUIZ_FIELDS)), say("unknown field in the quiz: ", F.col("k"))),
        found(wanted.where(~positive), say("a positive whole number is wanted: ", F.col("k"))),
    )


@rule("menu-orphan", applies=has_menu)
def menu_orphan(c: Corpus) -> DataFrame:
    """Each checked site page below the configured roots is a page, or the instructions, of the menu."""
    roots = F.lit(False)
    for r in c.conf["check"]["orphan_roots"]:
        roots = roots | c.in_course().startswith(r.rstrip("/") + "/") | (c.in_course() == r)
    covered = targets(c).where(F.col("kind").isin("page", "instructions")).select(F.col("target").alias("path"))
    pages = c.pages.where("is_site and is_checked").where(roots).select("path").join(covered, "path", "left_anti")
    if c.courses:  # of a course without a menu nothing is asked
        pages = pages.withColumn("course", c.course()).join(c.menu.select(c.course().alias("course")).distinct(), "course", "left_semi")
    return found(pages, "not in the menu")


@rule("topic-frame", applies=has_menu)
def topic_frame(c: Corpus) -> DataFrame:
    """A menu page does not open another page of the corpus inside its own frame; each anchor counts."""
    on_menu = targets(c).where("kind = 'page'").select(F.col("target").alias("path")).distinct()
    pages = c.texts.join(on_menu, "path", "left_semi").select("path", tx.without_comments("html").alias("html"))
    anchors = pages.select("path", F.explode(tx.every("html", r"(?is)(<a\s[^>]*>)")).alias("a"))
    href = F.coalesce(tx.first("a", r'(?i)href\s*=\s*"([^"]*)"'), tx.first("a", r"(?i)href\s*=\s*'([^']*)'"))
    blank = F.col("a").rlike(r"""(?i)target\s*=\s*["']_blank["']""")
    to = anchors.withColumn("href", href).where(F.col("href").isNotNull() & ~blank & ~starts_with_any(F.col("href"), NO_FRAME)).withColumn("target", tx.local_target("path", "href"))
    into = to.where((tx.extension("target") == ".html") & (F.col("target") != F.col("path"))).join(c.files.select(F.col("path").alias("target")), "target", "left_semi")
    return found(into, F.concat(F.lit("opens inside the frame: "), "target"))


def expected_title(kind, part):
    """Title of a code topic of this kind and part."""
    return F.when(kind == "test", "QR code: test").when(F.coalesce(part, F.lit("")) != "", F.concat(F.lit("QR code: "), part)).otherwise("QR code")


@rule("menu-names", applies=has_menu)
def menu_names(c: Corpus) -> DataFrame:
    """Names of dropboxes, grades and code topics follow from the name of the nearest module above."""
    words = c.conf["check"]["names"]
    chosen = [words["graded"], words["ungraded"], words["test"]]
    if len(set(chosen)) < 3 or any(not w.strip() or w != w.strip() or set("(:") & set(w) for w in chosen):
        return single(c, "config", "check.names must be different words without colon or bracket")
    all_nodes = nodes(c)
    modules = all_nodes.where("kind = 'module'")
    # each menu's module names, in order of first appearance: an array bounded by one menu
    first = modules.where("own_name is not null").groupBy("path", "own_name").agg(F.min("ord").alias("ord"))
    named = first.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "own_name"))), lambda x: x["own_name"]).alias("names"))
    parse = names_parser(ungraded=words["ungraded"], test=words["test"], graded=words["graded"])
    topics = all_nodes.where("kind = 'topic'").join(named, "path", "left")
    drops = topics.where("dropbox is not null").withColumn("p", parse("dropbox", "name", "names"))
    good = drops.where("p.kind is not null").groupBy("path", F.col("dropbox").alias("box")).agg(F.max_by("p", "ord").alias("scored"))
    v = F.try_parse_json("qr")
    text_of = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    codes = topics.where(F.col("has_qr") & F.schema_of_variant(v).startswith("OBJECT")).withColumn("box", text_of("dropbox")).withColumn("grade", text_of("grade"))
    by_grade = codes.where("box is null and grade is not null").withColumn("p", parse("grade", "name", "names"))
    scored = codes.join(good, ["path", "box"]).unionByName(by_grade.where("p.kind in ('test', 'assignment')").withColumnRenamed("p", "scored"), allowMissingColumns=True)
    want = expected_title(F.col("scored.kind"), F.col("scored.part"))
    return union(
        found(modules.where("bad_name"), F.concat(F.lit("module name: "), F.coalesce("id", F.lit("?")))),
        found(drops.where("p.kind is null"), F.concat(F.lit("dropbox "), "dropbox", F.lit(": "), "p.part")),
        found(by_grade.where("p.kind is null"), F.concat(F.lit("grade "), "grade", F.lit(": "), "p.part")),
        found(by_grade.where("p.kind = 'report'"), F.concat(F.lit("grade "), "grade", F.lit(": a report has no score"))),
        found(scored.withColumn("want", want).where(~F.col("title").eqNullSafe(F.col("want"))), F.concat(F.lit("topic "), F.coalesce("id", F.lit("?")), F.lit(": the title should be "), "want")),
    )
