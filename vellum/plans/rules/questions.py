"""Rules on question lists and on chapters with their manifest."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.corpus import Corpus
from vellum.functions import text as tx
from vellum.functions.kernels import blanks_udf, choices_udf
from vellum.plans.registry import WARNING, any_rows, found, rule, single, union
from vellum.plans.rules.links import document_pattern, folders, looked_up
from vellum.sources.literals import manifest_modules

CORRECT = r'class="[^"]*\bjuist\b'
ANSWER = r'(?s)<div class="oplossing">(?!\s*</div>)\s*\S'


def has_questions(c: Corpus):
    return any_rows(c.questions, "no question list")


def chapters(c: Corpus) -> DataFrame:
    return c.pages.where(c.in_syllabus("path"))


def has_chapters(c: Corpus):
    return any_rows(chapters(c), "no chapters")


def questions(c: Corpus) -> DataFrame:
    """path, nr, tag, body of each question, numbered over all lists of its page."""
    items = c.questions.select("path", "begin", F.posexplode("items").alias("pos", "i"))
    return items.select("path", (F.col("begin") + F.col("pos")).alias("nr"), "i.tag", "i.body")


@rule("vragen-answered", applies=has_questions)
def answered(c: Corpus) -> DataFrame:
    """A choice question has exactly one correct choice, an open one a filled answer."""
    rows = questions(c).withColumn("choices", choices_udf("body")).withColumn("n", F.size(F.filter("choices", lambda x: x["tag"].rlike(CORRECT))))
    closed = rows.where((F.size("choices") > 0) & (F.col("n") != 1))
    open_ = rows.where((F.size("choices") == 0) & ~F.col("body").rlike(ANSWER))
    return union(found(closed, F.format_string("question %d has %d correct choices", "nr", "n")), found(open_, F.format_string("question %d has no answer", "nr")))


@rule("vragen-numbering", applies=has_questions)
def numbering(c: Corpus) -> DataFrame:
    """A list goes on where the one before it ended; the first failure of a page counts, empty lists do not."""
    wrong = c.questions.where((F.size("items") > 0) & F.when(F.col("declared"), F.col("begin") != F.col("expected")).otherwise(F.col("expected") != 1))
    firsts = wrong.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy("list_no"))).where("rn = 1")
    return found(firsts, F.when(F.col("declared"), F.format_string("a list starts at %d, expected %d", "begin", "expected")).otherwise(F.format_string("a list lacks start %d", "expected")))


@rule("vragen-class", applies=has_chapters)
def list_class(c: Corpus) -> DataFrame:
    """A chapter without questions has no numbered list with blanks to fill in."""
    pages = chapters(c).where(F.col("html").contains("invulruimte"))
    with_questions = c.questions.where(F.size("items") > 0).select("path").distinct()
    return found(pages.join(with_questions, "path", "left_anti").where(blanks_udf("html")), "a list with blanks without the question class")


@rule("importer-guess", applies=has_chapters)
def importer_guess(c: Corpus) -> DataFrame:
    """No guess of the importer is left; each counts."""
    hits = chapters(c).select("path", F.explode(tx.numbered("html", r'data-geraden="([^"]*)"', 1)).alias("m"))
    return found(hits, F.concat(F.lit("unsettled guess: "), "m.text"), line="m.nr")


def has_manifest(c: Corpus):
    return any_rows(c.texts.where(F.col("path") == c.conf["syllabus"]["manifest"]).select("path").unionAll(chapters(c).select("path")), "no chapters")


@rule("syllabus-manifest", applies=has_manifest)
def manifest(c: Corpus) -> DataFrame:
    """The manifest lists each chapter page once, by existing relative paths; pages and topics are matched both ways."""
    name, conf = c.conf["syllabus"]["manifest"], c.conf
    text = c.text_of(name)
    if text is None:
        return single(c, name, "is missing")
    modules = manifest_modules(text)
    if not modules:
        empty = re.search(r"=\s*\{\s*\}\s*;", text)
        return single(c, name, "is empty", WARNING) if empty else single(c, name, "has no module")
    src, folder, labo = (conf["paths"][k] for k in ("syllabus_src", "syllabus_dir", "labo"))
    bases = (labo, folder.rpartition("/")[0])
    names = sorted({m["module"].lower() for m in modules})
    # only the folders that a module of this manifest may mean: a few for each module
    like = folders(c).where(tx.parent("path").isin(*bases) & F.lower(tx.basename("path")).isin(*names))
    tops = sorted(r["path"] for r in like.collect())

    def theory(module: str) -> str:
        """The folder of a module's pages; of several candidates the last wins."""
        out = f"{labo}/{module.upper()}/Theorie"
        for base in bases:
            for t in (x for x in tops if x.rpartition("/")[0] == base and x.rpartition("/")[2].lower() == module.lower()):
                out = src if t == folder else f"{t}/Theorie"
        return out

    rows = [(m["module"], theory(m["module"]), i, t.get("id"), t.get("name"), t.get("href"), json.dumps(sorted(t))) for m in modules for i, t in enumerate(m["topics"])]
    topics = c.spark.createDataFrame(rows, "module string, dir string, ord int, id string, name string, href string, keys string").withColumn("path", F.lit(name))
    at = [(m["module"], theory(m["module"]), m["n_categories"]) for m in modules]
    there = folders(c).select(F.col("path").alias("dir"), F.lit(True).alias("there"))
    heads = c.spark.createDataFrame(at, "module string, dir string, n int").join(there, "dir", "left").select("module", "dir", "n", F.coalesce("there", F.lit(False)).alias("has_dir")).withColumn("path", F.lit(name))
    topics = topics.join(heads.where("has_dir").select("module"), "module", "left_semi")
    say = lambda text, *more: F.concat(F.col("module"), F.lit(f": {text}"), *more)
    fields = topics.select("path", "module", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("id", "name", "href")))).alias("f")).where("coalesce(f.v, '') = ''")
    twice = topics.withColumn("rn", F.row_number().over(Window.partitionBy("module", "id").orderBy("ord"))).where("rn > 1")
    to = looked_up(topics.withColumn("target", tx.fold_path(F.concat_ws("/", "dir", F.coalesce("href", F.lit(""))))), c)
    wrong = to.withColumn("cause", F.when(~F.col("exists"), "leads nowhere: ").when(~F.col("exact"), "the case does not match: ")).where("cause is not null")
    listed = to.where(F.col("exact") & ~F.coalesce("href", F.lit("")).rlike(document_pattern(c))).select("module", F.col("target").alias("path"))
    dirs = heads.where("has_dir").select("module", F.concat("dir", F.lit("/")).alias("dir"))
    below = c.pages.select("path").join(F.broadcast(dirs), F.col("path").startswith(F.col("dir")))  # one row for each module of the manifest
    return union(
        found(heads.where("n = 0"), say("no category")),
        found(heads.where("not has_dir"), say("no folder of pages")),
        found(fields, say("a field is missing: ", F.col("f.k"))),
        found(topics.where("href like 'http%'"), say("absolute address")),
        found(twice, say("id occurs twice: ", F.coalesce("id", F.lit("?")))),
        found(wrong, F.concat("module", F.lit(": "), "cause", F.coalesce("href", F.lit("")))),
        found(below.join(listed, ["module", "path"], "left_anti"), "not in the manifest"),
    )
