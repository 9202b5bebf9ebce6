"""Links, sources and assets of pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.corpus import Corpus
from vellum.functions import text as tx
from vellum.functions.kernels import unescape_udf
from vellum.operators.contains import occurring
from vellum.plans.registry import ERROR, WARNING, any_rows, found, rule, single, union

URL = r'(?:href|src)\s*=\s*"([^"]+)"'
#: Links that lead to no file of the corpus (fixed values).
OUTSIDE = ("http://", "https://", "//", "/d2l/", "#", "mailto:", "tel:", "data:", "javascript:")
DOCUMENTS = ("pdf", "zip", "docx?", "pptx?", "xlsx?")
PLANNED = "TODO-"


def starts_with_any(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def document_pattern(c: Corpus) -> str:
    extra = [re.escape(e.lstrip(".")) for e in c.conf["check"]["remote_document_exts_extra"]]
    return r"(?i)\.(" + "|".join([*DOCUMENTS, *extra]) + r")(?:[?#]|$)"


def folders(c: Corpus) -> DataFrame:
    """path of each folder that holds a file, however deep."""
    parts = F.split("path", "/")
    above = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), lambda p: p != F.col("path"))
    return c.files.select(F.explode(above).alias("path")).distinct()


def looked_up(rows: DataFrame, c: Corpus, target: str = "target") -> DataFrame:
    """Adds exists (in any case), exact (in this case) and tracked for a path column.

    Two equi-joins with the file list, on the path and on its lower-cased form; a
    folder of a listed file exists too.
    """
    known = c.files.select("path", F.coalesce("tracked", F.lit(False)).alias("tracked"), F.lit(True).alias("is_file")).unionByName(folders(c).select("path", F.lit(False).alias("tracked"), F.lit(False).alias("is_file")))
    exact = known.select(F.col("path").alias(target), F.lit(True).alias("exact"), "tracked", "is_file")
    lower = known.select(F.lower("path").alias("low"), "is_file").groupBy("low").agg(F.max("is_file").alias("low_file"))
    out = rows.join(exact, target, "left").withColumn("low", F.lower(target)).join(lower, "low", "left")
    return out.withColumn("exists", F.col("low_file").isNotNull()).withColumn("exact", F.coalesce("exact", F.lit(False))).withColumn("tracked", F.coalesce("tracked", F.lit(False))).withColumn("is_file", F.coalesce("is_file", "low_file", F.lit(False))).drop("low", "low_file")


def page_links(c: Corpus) -> DataFrame:
    """path, url, target of each link on a checked page that leads into the corpus."""
    urls = c.checked.select("path", F.explode(tx.every("html", URL)).alias("url")).where(~starts_with_any(F.col("url"), OUTSIDE))
    return urls.withColumn("target", tx.local_target("path", "url")).where(F.col("target").isNotNull())


@rule("links")
def links(c: Corpus) -> DataFrame:
    """Each relative link leads to a file, in exactly this case, under version control.

    One outcome for each link, in this order: a planned asset is a warning; missing;
    other case; not tracked.  Links out of the corpus are not tracked.
    """
    rows = looked_up(page_links(c), c)
    cause = (
        F.when(tx.basename("target").startswith(PLANNED), "planned asset: ")
        .when(F.col("target").startswith("../") | ~F.col("exists"), "leads nowhere: ")
        .when(~F.col("exact"), "the case does not match: ")
        .when(F.lit(c.has_git) & F.col("is_file") & ~F.col("tracked"), "not under version control: ")
    )
    bad = rows.withColumn("cause", cause).where("cause is not null")
    out = found(bad, F.concat("cause", "url"), severity=F.when(F.col("cause") == "planned asset: ", WARNING).otherwise(ERROR))
    return out if c.has_git else union(single(c, ".", "no version control, tracked files are not checked", WARNING), out)


@rule("data-bron", applies=lambda c: any_rows(c.checked.where(F.col("html").rlike(r'\bdata-bron="')), "no source attribute"))
def data_bron(c: Corpus) -> DataFrame:
    """Source attributes list bare paths from the root that exist in this case."""
    attrs = c.checked.select("path", F.explode(tx.numbered(tx.blank_comments("html"), r'\bdata-bron="([^"]*)"', 1)).alias("m")).select("path", "m.nr", tx.squeeze("m.text").alias("text"))
    empty = found(attrs.where("text = ''"), "empty source attribute", line="nr")
    each = attrs.where("text <> ''").select("path", "nr", F.explode(F.split("text", " ")).alias("raw")).withColumn("target", unescape_udf("raw"))
    rows = looked_up(each, c)
    bare = ~F.col("target").startswith("/") & ~F.col("target").startswith("../") & (tx.fold_path(F.col("target")) == F.col("target"))
    cause = F.when(~bare, "not a path from the root: ").when(~(F.col("exists") & F.col("is_file")), "does not exist: ").when(~F.col("exact"), "the case does not match: ")
    return union(empty, found(rows.withColumn("cause", cause).where("cause is not null"), F.concat("cause", "target"), line="nr"))


def contains_rule(id: str, doc: str, patterns, message: str) -> None:
    def run(c: Corpus) -> DataFrame:
        hit = F.lit(False)
        for p in patterns(c):
            hit = hit | F.col("html").contains(p)
        return found(c.checked.where(hit), message)

    run.__doc__ = doc
    rule(id)(run)


def match_rule(id: str, doc: str, pattern, message: str, keep=lambda c, url: F.lit(True)) -> None:
    """One finding for each match on a checked page."""

    def run(c: Corpus) -> DataFrame:
        hits = c.checked.select("path", F.explode(tx.every("html", pattern(c))).alias("url")).where(keep(c, F.col("url")))
        return found(hits, F.concat(F.lit(message + ": "), F.col("url")))

    run.__doc__ = doc
    rule(id)(run)


contains_rule("platform-hotlink", "No path into the files of the teaching platform; it changes every year.", lambda c: c.conf["check"]["platform_paths"], "links into the platform's files")
match_rule("remote-image", "Images are hosted by the corpus itself.", lambda c: r'<img[^>]+src="(https?://[^"]+)"', "remote image")
match_rule("remote-document", "Documents are hosted by the corpus itself; the extension tells a document.", lambda c: r'href="(https?://[^"]+)"', "remote document", lambda c, url: url.rlike(document_pattern(c)))
match_rule("youtube-referrer", "An embedded video states its referrer policy.", lambda c: r"(?i)(<iframe[^>]+youtube[^>]*>)", "embed without referrer policy", lambda c, tag: ~tag.contains("referrerpolicy"))
match_rule("legacy-platform-link", "No link to a retired host.", lambda c: r'(?:src|href)="(https?://(?:' + "|".join(map(re.escape, c.conf["check"]["retired_hosts"])) + r')[^"]*)"', "link to a retired host")


@rule("theme-wiring")
def theme_wiring(c: Corpus) -> DataFrame:
    """Each checked site page loads the hosted style sheet and script."""
    pages = c.pages.where("is_site and is_checked")
    return union(*(found(pages.where(~F.col("html").contains(c.conf["theme"][k])), f"does not load the hosted {k}") for k in ("css", "js")))


@rule("foreign-assets")
def foreign_assets(c: Corpus) -> DataFrame:
    """Site pages load the theme and files of the corpus, nothing else by absolute address; scripts come before style sheets."""
    scripts = tx.every("html", r'(?i)<script[^>]+src="([^"]*)"')
    sheets = F.transform(tx.every("html", r'(?i)(<link[^>]+rel="stylesheet"[^>]*>)'), lambda t: F.regexp_extract(t, r'(?i)href="([^"]*)"', 1))
    urls = c.pages.where("is_site and is_checked").select("path", F.explode(F.concat(scripts, sheets)).alias("url"))
    foreign = urls.where(~F.col("url").isin(*c.conf["theme"].values()) & starts_with_any(F.col("url"), ("http://", "https://", "//", "/")))
    return found(foreign, F.concat(F.lit("loads a foreign asset: "), "url"))


@rule("checklist-wiring", applies=lambda c: any_rows(c.checked.where(F.col("html").contains('class="checklist"')), "no page with a checklist"))
def checklist_wiring(c: Corpus) -> DataFrame:
    """A checklist loads its script and names its own lab."""
    pages = c.checked.where(F.col("html").contains('class="checklist"'))
    lab = F.concat(F.lit("labo"), tx.first("path", r"^Labo([0-9]+)/"))
    named = tx.first("html", r"""initChecklistSync\(\{\s*labId:\s*["']([A-Za-z0-9_-]+)["']""")
    rows = pages.select("path", F.col("html").contains("checklist-sync.js").alias("synced"), lab.alias("lab"), named.alias("named"))
    return union(found(rows.where(~F.col("synced")), "a checklist without its script"), found(rows.where("named is null"), "a checklist that is never set up"), found(rows.where("named is not null and lab is not null and named <> lab"), F.concat(F.lit("a checklist of another lab: "), "named")))


@rule("orphan-image", applies=lambda c: any_rows(c.files.where(F.col("path").startswith(c.conf["paths"]["img"] + "/syllabus-")), "no chapter images"))
def orphan_image(c: Corpus) -> DataFrame:
    """The name of each chapter image occurs in some page, style sheet or script; the logo is exempt.

    The images' names go to the texts, which are read once.
    """
    folder = c.conf["paths"]["img"] + "/"
    images = c.files.where(F.col("path").startswith(folder + "syllabus-")).select("path", tx.basename("path").alias("name")).where(F.col("name") != c.conf["syllabus"]["logo"])
    texts = c.texts.where(F.lower("path").rlike(r"\.(html|css|js)$") & ~tx.has_part("path", c.conf["staging"])).select("html")
    return found(images.join(occurring(images, texts), "name", "left_anti"), "used by no page")


@rule("schrijfstijl-nummers", applies=lambda c: any_rows(c.texts.where(c.is_own(c.conf["style_guide"]["file"])), "no style guide"))
def style_numbers(c: Corpus) -> DataFrame:
    """The local style guide refers to the base and uses no number that the base lacks."""
    conf = c.conf["style_guide"]
    guide = c.texts.where(c.is_own(conf["file"]))
    known = c.spark.createDataFrame([(int(n),) for n in conf["base_numbers"]], "n int")
    used = guide.select("path", F.explode(tx.numbered("html", r"(?m)^#{2,6}\s+(\d+)\.", 1)).alias("m")).select("path", "m.nr", F.col("m.text").cast("int").alias("n"))
    return union(found(guide.where(~F.col("html").contains(conf["reference"])), "does not refer to the base guide"), found(used.join(known, "n", "left_anti"), F.concat(F.lit("unknown pattern "), F.col("n").cast("string")), line="nr"))


@rule("skill-basis", applies=lambda c: any_rows(c.files.where(F.col("path").startswith(f"{c.conf['skills']['folder']}/{c.conf['skills']['prefix']}")), "no shared skills"))
def skill_basis(c: Corpus) -> DataFrame:
    """A shared skill folder has its file, a base of the same name, and a reference to it; the first failure counts."""
    conf = c.conf["skills"]
    depth = len(conf["folder"].split("/"))
    folder = F.element_at(F.split("path", "/"), depth + 1)
    folders = c.files.where(F.col("path").startswith(f"{conf['folder']}/{conf['prefix']}") & (F.size(F.split("path", "/")) > depth + 1)).select(folder.alias("dir")).distinct()
    own = c.texts.select(F.col("path").alias("file"), "html")
    base = c.spark.createDataFrame([(n, r) for n, r in conf["base"].items()], "base string, reference string")
    rows = folders.select(F.concat(F.lit(conf["folder"] + "/"), "dir").alias("path"), F.expr(f"substring(dir, {len(conf['prefix']) + 1})").alias("base")).withColumn("file", F.concat("path", F.lit("/SKILL.md"))).join(own, "file", "left").join(base, "base", "left")
    cause = F.when(F.col("html").isNull(), "a skill folder without its file").when(F.col("reference").isNull(), "no base of this name").when(~F.col("html").contains(F.col("reference")), "does not refer to its base")
    bad = rows.withColumn("cause", cause).where("cause is not null")
    return found(bad, F.col("cause"), path=F.when(F.col("html").isNull(), F.col("path")).otherwise(F.col("file")))
