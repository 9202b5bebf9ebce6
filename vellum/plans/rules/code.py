"""Rules on single lines and on code blocks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.corpus import Corpus
from vellum.functions import text as tx
from vellum.functions.kernels import shared_brace_udf, squeezed_udf, tight_udf, unclosed_udf
from vellum.plans.registry import found, rule, union


@rule("em-dash")
def em_dash(c: Corpus) -> DataFrame:
    """No em-dash, as a character or an entity, on any page."""
    return found(c.pages.where(F.col("html").rlike("&mdash;|—")), "em-dash in the text")


def block_pattern(languages: list[str]) -> str:
    return r'(?s)<pre class="code-wrapper[^"]*language-(?:' + "|".join(map(re.escape, languages)) + r')[^"]*"[^>]*>(.*?)</pre>'


def code_lines(c: Corpus) -> DataFrame:
    """path, nr (on the page), k (in the block), line of each code line of the configured languages."""
    blocks = c.pages.select("path", F.explode(tx.numbered("html", block_pattern(c.conf["check"]["code_style_languages"]), 1)).alias("b"))
    lines = blocks.select("path", "b.nr", F.posexplode(F.split("b.text", "\n", -1)).alias("pos", "line"))
    return lines.select("path", (F.col("nr") + F.col("pos")).alias("nr"), (F.col("pos") + 1).alias("k"), "line")


@rule("code-style", applies=lambda c: True if c.conf["check"]["code_style_languages"] else "no languages are configured")
def code_style(c: Corpus) -> DataFrame:
    """In code blocks a brace has a line of its own and operators have spaces; at most two findings a line."""
    lines = code_lines(c).withColumn("bare", F.rtrim(F.regexp_replace("line", r"//.*$", ""))).where(F.trim(F.regexp_replace("bare", r"\s", "")) != "")
    brace = lines.where(F.col("bare").contains("{")).where(shared_brace_udf("bare"))
    tight = lines.where(squeezed_udf("bare") | (F.size(tight_udf("line")) > 0))
    say = lambda what: F.concat(F.lit(f"code line: {what}: "), F.trim("bare"))
    return union(found(brace, say("the brace needs its own line"), line="nr"), found(tight, say("spaces around the operator"), line="nr"))


@rule("solution-placement")
def solution_placement(c: Corpus) -> DataFrame:
    """A solution container stands in a section whose heading id begins with oplossing.

    The nearest heading above is carried forward over the page's lines; a heading on
    the container's own line counts.
    """
    lines = c.lines.where("is_checked").select("path", "nr", "line").where(F.col("line").rlike(r'<h2|<div[^>]*class="[^"]*solution-container'))
    heading = F.when(F.col("line").contains("<h2"), F.coalesce(tx.first("line", r'^.*<h2[^>]*id="([^"]*)"'), F.lit("(no id)")))
    w = Window.partitionBy("path").orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))
    bad = rows.where(F.col("line").rlike(r'<div[^>]*class="[^"]*solution-container') & ~F.coalesce("section", F.lit("")).startswith("oplossing"))
    return found(bad, F.concat(F.lit("solution container under "), F.coalesce("section", F.lit("no heading"))), line="nr")


def line_rule(id: str, doc: str, pattern, message: str) -> None:
    def run(c: Corpus) -> DataFrame:
        return found(c.lines.where("is_checked").where(F.col("line").rlike(pattern(c))), message, line="nr")

    run.__doc__ = doc
    rule(id)(run)


line_rule("spoiler-retired", "The spoiler container is retired.", lambda c: r'<div[^>]*class="[^"]*spoiler-container', "a retired container")


@rule("reveal-script-retired")
def reveal_script_retired(c: Corpus) -> DataFrame:
    """Retired scripts are neither kept nor loaded."""
    names = c.conf["check"]["retired_scripts"]
    loads = r'<script[^>]*src="(?:[^"]*/)?(?:' + "|".join(map(re.escape, names)) + ')"'
    return union(found(c.files.where(F.col("path").isin(*names)), "a retired script"), found(c.lines.where("is_checked").where(F.col("line").rlike(loads)), "loads a retired script", line="nr"))


@rule("unclosed-comment")
def unclosed_comment(c: Corpus) -> DataFrame:
    """Each comment is closed before the next begins."""
    return found(c.pages.where(F.col("html").contains("<!--")).select("path", F.explode(unclosed_udf("html")).alias("nr")), "a comment that is not closed", line="nr")


def title_words(c: Corpus) -> str:
    """A generic title: one of the words and a number."""
    return "(?:" + "|".join(map(re.escape, c.conf["check"]["exercise_title_words"])) + r")\s*[0-9]"


@rule("exercise-name", applies=lambda c: True if c.conf["check"]["exercise_title_words"] else "no title words are configured")
def exercise_name(c: Corpus) -> DataFrame:
    """Neither the menu nor a heading names an exercise by number only."""
    menu = c.texts.where(F.col("path") == c.conf["menu"]).select("path", F.posexplode(F.split("html", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(r'(?iu)"title":\s*"[^"]*' + title_words(c)))
    pages = c.lines.where("is_checked").where(F.col("line").rlike(r"(?iu)<(h1|title)>[^<]*" + title_words(c)))
    return union(found(menu, F.concat(F.lit("generic title: "), F.trim("line")), line=F.col("pos") + 1), found(pages, F.concat(F.lit("generic heading: "), F.trim("line")), line="nr"))
