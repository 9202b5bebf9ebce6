"""Rules on the overview page of a module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.corpus import Corpus
from vellum.functions import text as tx
from vellum.operators.runs import shared_runs
from vellum.plans.registry import any_rows, found, rule, union

#: Number words of the session phrase (fixed values).
NUMBERS = "een|één|twee|drie|vier|vijf|zes|zeven|acht|negen|tien"


def overviews(c: Corpus) -> DataFrame:
    return c.pages.where(tx.depth_glob("path", "overview.html", (2,))).select("path", tx.without_comments("html").alias("html"))


def assignments(c: Corpus) -> DataFrame:
    """Assignment pages, two or three folders deep."""
    return c.pages.where(tx.depth_glob("path", "Opdracht.html", (2, 3)))


def has_overview(c: Corpus):
    return any_rows(overviews(c), "no overview page")


@rule("no-verloop", applies=has_overview)
def no_sequence(c: Corpus) -> DataFrame:
    """An overview has neither a sequence heading nor a step container."""
    pages = overviews(c)
    heading = F.col("html").rlike(r'(?i)<h[1-6][^>]*\bid="verloop"|<h[1-6][^>]*>\s*verloop\b')
    return union(found(pages.where(heading), "a sequence heading"), found(pages.where(F.col("html").rlike(r'(?i)class="[^"]*\bsteps-container\b')), "a step container"))


@rule("no-session-count", applies=has_overview)
def no_session_count(c: Corpus) -> DataFrame:
    """An overview does not say how many sessions are planned."""
    phrase = rf"(?iU)\b({NUMBERS}|\d+)\s+sessies?\b[^.]{{0,80}}?\bvoorzien\b"
    return found(overviews(c).where(tx.strip_tags("html").rlike(phrase)), "a session count")


@rule("no-weight", applies=has_overview)
def no_weight(c: Corpus) -> DataFrame:
    """An overview gives no weight in percent."""
    return found(overviews(c).where(F.col("html").rlike(r"\[\s*\d{1,3}\s*%\s*\]")), "a weight in percent")


def lead_words(html) -> Column:
    """Words of the lead paragraph; tags and entities are spaces."""
    lead = F.regexp_extract(html, r'(?is)<p class="[^"]*\blead\b[^"]*"[^>]*>(.*?)</p>', 1)
    plain = F.lower(F.regexp_replace(F.regexp_replace(lead, tx.TAG, " "), r"(?i)&[a-z]+;|&#\d+;", " "))
    return tx.every(plain, r"(?U)[\w/-]+", 0)


@rule("duplicate-lead", applies=has_overview)
def duplicate_lead(c: Corpus) -> DataFrame:
    """Two leads of one module share no run of words; the run's length is configured."""
    over = overviews(c).select(tx.parent("path").alias("module"), "path", F.lit(0).alias("rank"), "html")
    tasks = assignments(c).select("path", tx.without_comments("html").alias("html"))
    two = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    tasks = tasks.select(two.alias("module"), "path", (F.size(F.split("path", "/")) - 2).alias("rank"), "html").join(over.select("module"), "module", "left_semi")
    leads = over.unionByName(tasks).select("module", "path", "rank", lead_words(F.col("html")).alias("words"))
    pairs = shared_runs(leads, "module", ["rank", "path"], "words", c.conf["check"]["shared_words"])
    return found(pairs, F.concat(F.lit("shares a run with "), F.col("b.path"), F.lit(": "), F.array_join("run", " ")), path="a.path")
