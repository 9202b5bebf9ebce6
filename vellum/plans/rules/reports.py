"""Rules on assignment pages and the report blocks in their comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.corpus import Corpus
from vellum.functions import text as tx
from vellum.functions.kernels import unclosed_udf
from vellum.plans.registry import any_rows, found, rule, union
from vellum.plans.rules.hub import assignments

MARK = r'(?i)class="[^"]*\b(vragen|verslag-kader)\b'
OPT_OUT = r"<!--\s*geen-verslag[\s:]"
OPENING = r"(?is)^(laat|vraag de lector)\b[^.]*\bcontroleren\b"
ANYWHERE = r"(?is)\b(laat|lector)\b[^.]*\bcontroleren\b"
TEMPLATE_LINK = r'href="([^"]*downloads/[^"]+\.docx)"'
BUTTON = "Opdracht downloaden"


def has_assignment(c: Corpus):
    return any_rows(assignments(c), "no assignment page")


def closed_pages(c: Corpus) -> DataFrame:
    """All pages whose comments are closed, with is_task and in_lab."""
    tasks = assignments(c).select("path", F.lit(True).alias("is_task"))
    pages = c.pages.where(~F.col("html").contains("<!--") | (F.size(unclosed_udf("html")) == 0)).join(tasks, "path", "left")
    return pages.withColumn("is_task", F.coalesce("is_task", F.lit(False))).withColumn("in_lab", tx.has_part("path", [c.conf["paths"]["labo"]]))


def report_blocks(pages: DataFrame) -> DataFrame:
    """path, block: comments that begin with verslag."""
    return pages.select("path", F.explode(tx.every("html", tx.COMMENT)).alias("block")).where(F.trim(F.regexp_replace("block", r"^\s+", "")).startswith("verslag"))


@rule("verslag-markup", applies=has_assignment)
def report_markup(c: Corpus) -> DataFrame:
    """Report classes stand in report blocks, blocks hold a list or frame, and report tables have even rows."""
    pages = closed_pages(c)
    marks = F.filter(F.transform(tx.every(tx.without_comments("html"), MARK), F.lower), lambda m: F.col("is_task") | (m != "vragen"))
    outside = pages.where("in_lab").withColumn("mark", F.get(marks, F.lit(0))).where("mark is not null")
    empty = report_blocks(pages).where(~F.col("block").rlike(MARK))
    tables = pages.select("path", F.explode(tx.every("html", r'(?s)<table class="[^"]*verslag-tabel[^"]*">(.*?)</table>')).alias("t")).withColumn("heads", F.regexp_count("t", F.lit("<th[ >]")))
    rows = tables.where("heads > 0").select("path", "heads", F.posexplode(tx.every("t", r"(?s)<tr[^>]*>(.*?)</tr>")).alias("pos", "r")).withColumn("cells", F.regexp_count("r", F.lit("<td[ >]")))
    return union(
        found(outside, F.concat(F.lit("outside a report block: "), "mark")),
        found(empty, "a report block without list or frame"),
        found(tables.where("heads = 0"), "a report table without headers"),
        found(rows.where("cells > 0 and cells <> heads"), F.format_string("report table row %d: %d cells, %d headers", F.col("pos") + 1, "cells", "heads")),
    )


def unmarked(rows: DataFrame, text: Column, pattern: str) -> DataFrame:
    """path, sentence: plain paragraphs that ask for a check."""
    paras = rows.select("path", F.explode(tx.every(text, r"(?is)(<p\b[^>]*>.*?</p>)")).alias("p")).where(~F.regexp_extract("p", r"(?i)^<p\b([^>]*)>", 1).rlike(r'class="[^"]*\bcontrole\b'))
    return paras.select("path", tx.strip_tags(F.regexp_replace("p", r"(?i)^<p\b[^>]*>|</p>$", " ")).alias("sentence")).where(F.col("sentence").rlike(pattern))


@rule("verslag-controle", applies=has_assignment)
def report_check(c: Corpus) -> DataFrame:
    """A sentence that asks for a check stands in a paragraph of its own class; inside report blocks any such sentence does."""
    pages = closed_pages(c)
    blocks = report_blocks(pages.where("is_task"))
    say = F.concat(F.lit("asks for a check in a plain paragraph: "), F.substring("sentence", 1, 70))
    return union(
        found(unmarked(pages.where("in_lab"), tx.without_comments("html"), OPENING), say),
        found(blocks.where(F.col("block").rlike(r'(?i)class="[^"]*\binfo-box\b[^"]*\bevaluation\b')), "an evaluation box in a report block"),
        found(unmarked(blocks, F.col("block"), ANYWHERE), say),
    )


@rule("opdracht-lead", applies=has_assignment)
def assignment_lead(c: Corpus) -> DataFrame:
    """An assignment has a lead outside comments."""
    return found(assignments(c).where(~tx.without_comments("html").rlike('<p class="[^"]*lead[^"]*"')), "no lead")


@rule("download-button", applies=has_assignment)
def download_button(c: Corpus) -> DataFrame:
    """The button that offers the template has its fixed text."""
    button = tx.first("html", r'(?is)<a\b[^>]*href="[^"]*downloads/[^"]+\.docx"[^>]*>(.*?)</a>')
    rows = assignments(c).where(~F.col("html").rlike(OPT_OUT)).withColumn("label", tx.strip_tags(button)).where("label is not null")
    return found(rows.where(F.col("label") != BUTTON), F.concat(F.lit("the download button says: "), "label"))
