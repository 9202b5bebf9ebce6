"""Rules that compare times of derived files with those of their sources; only on a working copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.corpus import Corpus
from vellum.functions import text as tx
from vellum.plans.registry import WARNING, any_rows, found, rule, single, union
from vellum.plans.rules.hub import assignments
from vellum.plans.rules.questions import chapters, has_chapters
from vellum.plans.rules.reports import OPT_OUT, TEMPLATE_LINK, has_assignment


def first_newer(derived: DataFrame, sources: DataFrame, key: str = "derived") -> DataFrame:
    """derived(key, mtime) with the first newer of sources(key, source, source_mtime, ord...): an inequality join on the key, one row each."""
    newer = derived.join(sources, key).where("source_mtime > mtime")
    w = Window.partitionBy(key).orderBy("ord", "source")
    return newer.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def style_rows(c: Corpus, names: dict[str, int], paths: DataFrame) -> DataFrame:
    """paths(derived) with the times of those style sheets, by name and place in the order, that the corpus knows."""
    known = [F.struct(F.lit(n).alias("source"), F.lit(float(c.styles[n])).alias("source_mtime"), F.lit(o).alias("ord")) for n, o in names.items() if n in c.styles]
    if not known:
        return c.spark.createDataFrame([], "derived string, source string, source_mtime double, ord int")
    return paths.select("derived", F.explode(F.array(*known)).alias("s")).select("derived", "s.source", "s.source_mtime", "s.ord")


def sources_of(c: Corpus, paths: DataFrame, ord: int) -> DataFrame:
    """Times of paths(derived, source)."""
    return paths.join(c.files.select(F.col("path").alias("source"), F.col("mtime").alias("source_mtime")), "source").select("derived", "source", "source_mtime", F.lit(ord).alias("ord"))


def derived_files(c: Corpus, paths: DataFrame) -> DataFrame:
    return paths.select("derived").distinct().join(c.files.select(F.col("path").alias("derived"), "mtime"), "derived")


@rule("syllabus-stale", local_only=True, applies=has_chapters)
def syllabus_stale(c: Corpus) -> DataFrame:
    """The chapters' file is configured, exists, and is not older than a chapter or the style sheet; the first counts."""
    name = c.conf["syllabus"]["pdf"]
    if not name:
        return single(c, "config", "syllabus.pdf is not set")
    path = f"{c.conf['paths']['downloads']}/{name}"
    there = c.files.where(F.col("path") == path).select(F.lit(path).alias("derived"), "mtime")
    if there.isEmpty():
        return single(c, path, "does not exist")
    pages = sources_of(c, chapters(c).select(F.lit(path).alias("derived"), F.col("path").alias("source")), 0)
    style = style_rows(c, {"syllabus": 0}, there)
    return found(first_newer(there, pages.unionByName(style)), F.concat(F.lit("is older than "), "source"), path="derived")


def sheet_owner(path: str = "path"):
    """Folder of the lab that a cheat sheet belongs to: its own, or the one above a folder of theory."""
    own = tx.parent(path)
    return F.when(tx.basename(own) == "Theorie", tx.parent(own)).otherwise(own)


def decks(c: Corpus) -> DataFrame:
    folder = c.conf["paths"]["decks"] + "/"
    return c.pages.where(F.col("path").startswith(folder) & ~F.expr(f"substring(path, {len(folder) + 1})").contains("/"))


def handout_of(c: Corpus, path: str = "path"):
    return F.concat(F.lit(f"{c.conf['paths']['downloads']}/{c.conf['handout']['prefix']}"), tx.kebab(tx.stem(path)), F.lit(".pdf"))


def has_decks(c: Corpus):
    return "handout.prefix is not set" if not c.conf["handout"]["prefix"] else any_rows(decks(c), "no deck")


@rule("handout-stale", local_only=True, applies=has_decks)
def handout_stale(c: Corpus) -> DataFrame:
    """A handout that exists is not older than its deck, the style sheets, or its images, in that order."""
    pages = decks(c).withColumn("derived", handout_of(c))
    images = pages.select("derived", "path", F.explode(tx.every("html", r'(?is)<img\b[^>]*?\bsrc\s*=\s*"([^"]+)"')).alias("url")).where(~F.col("url").rlike("^(https?://|data:)"))
    figures = images.select("derived", tx.local_target("path", "url").alias("source")).distinct()
    sources = sources_of(c, pages.select("derived", F.col("path").alias("source")), 0).unionByName(style_rows(c, {"deck": 1, "handout": 2}, pages)).unionByName(sources_of(c, figures, 3))
    return found(first_newer(derived_files(c, pages), sources), F.concat(F.lit("is older than "), "source"), path="derived")


@rule("spiekblad-stale", local_only=True, applies=lambda c: any_rows(c.pages.where(tx.basename("path") == "Spiekblad.html"), "no cheat sheet"))
def sheet_stale(c: Corpus) -> DataFrame:
    """A linked cheat sheet exists and is not older than its page or the style sheet."""
    pages = c.pages.where(tx.basename("path") == "Spiekblad.html").withColumn("url", tx.first("html", r'href="([^"]*-spiekblad\.pdf)"')).where("url is not null")
    pages = pages.withColumn("derived", tx.local_target("path", "url"))
    there = c.files.select(F.col("path").alias("derived"))
    sources = sources_of(c, pages.select("derived", F.col("path").alias("source")), 0).unionByName(style_rows(c, {"spiekblad": 1}, pages))
    return union(found(pages.join(there, "derived", "left_anti"), F.concat(F.lit("the cheat sheet does not exist: "), "url")), found(first_newer(derived_files(c, pages), sources), F.concat(F.lit("is older than "), "source"), path="derived"))


@rule("verslag-stale", local_only=True, applies=has_assignment)
def template_stale(c: Corpus) -> DataFrame:
    """An assignment offers a template that exists and is not older than the page, unless it opts out."""
    pages = assignments(c).where(~F.col("html").rlike(OPT_OUT)).withColumn("url", tx.first("html", TEMPLATE_LINK))
    linked = pages.where("url is not null").withColumn("derived", tx.local_target("path", "url"))
    there = c.files.select(F.col("path").alias("derived"))
    sources = sources_of(c, linked.select("derived", F.col("path").alias("source")), 0)
    return union(
        found(pages.where("url is null"), "offers no template", severity=WARNING),
        found(linked.join(there, "derived", "left_anti"), "the template is missing"),
        found(first_newer(derived_files(c, linked), sources), F.concat(F.lit("is older than "), "source"), path="derived"),
    )
