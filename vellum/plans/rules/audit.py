"""Advisory rules on style; a page may opt out of each with a marker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.corpus import Corpus
from vellum.functions import text as tx
from vellum.plans.registry import DEVIATION, RULES, WARNING, found, rule, union

# Word lists of the style guide (fixed values; alternatives are regular expressions).
STOCK_LEAD = ["Hier lees je", "Hier zie je", "Hier ontdek je", "Hieronder lees je", "Hieronder zie je", "Op deze pagina (lees|zie|ontdek|vind|leer) je", "Op deze pagina (behandelen|bespreken) we", "In dit artikel"]
DIMINUTIVES = ["eentje", "blokjes?", "draadjes?", "schermpje", "lampje", "knopje", "regeltje", "woordje", "zinnetje", "lettertje", "motortje", "rommeltje", "duwtje", "trucje", "lijstjes?", "stukjes?", "stapjes?", "pootjes?"]
REGIONAL = ["[Kk]un je", "kunt", "wilt", "flinke?", "prima", "eventjes", "hartstikke", "gaaf", "nou ja"]
FILLERS = ["netjes", "heel even", "uiteraard", "natuurlijk"]
FORMAL = r"(?U)\b([Uu]w|[Uu] (kunt|kan|moet|hebt|zult|krijgt|ziet|maakt))\b"
LED = r"(?U)\bLEDs?\b"
PROSE_OF_LED = ["<p", "<li", "<td", "<th", "<h1", "<h2", "<h3", "<title>", "<caption>", "<figcaption", 'alt="', '"title":']
PROSE_OF_NAMES = ["<p>", "<p ", "<li", "<td", "<th", "<h1", "<h2", "<h3", "<title>", "<caption>", "<figcaption", 'alt="']
SUBMIT_SENTENCE = "<p>Sla je oefening op.</p>"


def skips(c: Corpus) -> DataFrame:
    """path, skip: the distinct opt-out markers of audited pages."""
    names = F.flatten(F.transform(tx.every("html", r"<!--\s*audit-skip:([^>]*?)-->"), lambda s: F.split(tx.squeeze(F.replace(s, F.lit(","), F.lit(" "))), " ")))
    return c.pages.where("is_audit").select("path", F.explode(F.array_distinct(names)).alias("skip")).where("skip <> ''")


def audited(c: Corpus, id: str, rows: DataFrame | None = None) -> DataFrame:
    """Audited pages (or other rows by path) that have not opted out of the rule."""
    rows = c.pages.where("is_audit") if rows is None else rows
    return rows.join(skips(c).where(F.col("skip") == id.removeprefix("audit-")).select("path"), "path", "left_anti")


def audit(id: str, applies: Callable[[Corpus], bool | str] = lambda c: True):
    return rule(id, mode="audit", applies=applies)


def has_any(c: Column, texts: list[str]) -> Column:
    out = F.lit(False)
    for t in texts:
        out = out | c.contains(t)
    return out


@audit("audit-skip")
def audit_skip(c: Corpus) -> DataFrame:
    """An opt-out names a rule that exists, and stays visible as a deviation."""
    valid = sorted(r.id.removeprefix("audit-") for r in RULES.values() if r.mode == "audit" and r.id != "audit-skip")
    known = F.col("skip").isin(*valid)
    return found(skips(c), F.when(known, F.concat(F.lit("audit-skip: "), "skip")).otherwise(F.concat(F.lit("unknown audit-skip: "), "skip")), severity=F.when(known, DEVIATION).otherwise(WARNING))


@audit("audit-code-class")
def code_class(c: Corpus) -> DataFrame:
    """A code block has an allowed language, line numbers, and the badge unless its language has none."""
    conf = c.conf["check"]["audit"]
    blocks = audited(c, "audit-code-class").select("path", F.explode(tx.every("html", r'class="(code-wrapper[^"]*)"')).alias("cls")).withColumn("lang", tx.first("cls", r"\blanguage-(\S+)"))
    wrong = (~F.coalesce(F.col("lang").isin(*conf["code_languages"]), F.lit(False))) if conf["code_languages"] else F.col("lang").isNull()
    fine = blocks.where(~wrong)
    no_badge = F.col("lang").isin(*conf["code_no_badge"]) if conf["code_no_badge"] else F.lit(False)
    badge = F.col("cls").contains("show-language")
    return union(
        found(blocks.where(wrong), F.concat(F.lit("language of a code block: "), "cls"), severity=WARNING),
        found(fine.where(~F.col("cls").contains("linenumbers")), "a code block without line numbers", severity=WARNING),
        found(fine.where(no_badge == badge), F.when(badge, "a badge that says nothing").otherwise("a code block without badge"), severity=WARNING),
    )


@audit("audit-lead-opener")
def lead_opener(c: Corpus) -> DataFrame:
    """The lead does not open with a stock formula."""
    formulas = "|".join(STOCK_LEAD + c.conf["check"]["audit"]["stock_lead_extra"])
    return found(audited(c, "audit-lead-opener").where(F.col("html").rlike(f'class="lead">.*({formulas})')), "a stock formula in the lead", severity=WARNING)


def word_hits(pages: DataFrame, text: str, words: list[str], keys: list[str]) -> DataFrame:
    """keys, word: each distinct hit of a word list in a text."""
    pattern = r"(?U)\b(" + "|".join(words) + r")\b"
    return pages.select(*keys, F.explode(F.array_sort(F.array_distinct(tx.every(text, pattern, 0)))).alias("word"))


def word_rule(id: str, doc: str, words: list[str], extra: str) -> None:
    def run(c: Corpus) -> DataFrame:
        return found(word_hits(audited(c, id), "html", words + c.conf["check"]["audit"][extra], ["path"]), F.concat(F.lit("word: "), "word"), severity=WARNING)

    run.__doc__ = doc
    audit(id)(run)


word_rule("audit-verkleinwoord", "No diminutive that embellishes a part.", DIMINUTIVES, "diminutives_extra")
word_rule("audit-noord-nederlands", "Words of the region.", REGIONAL, "noord_nl_extra")
word_rule("audit-vulwoord", "No adverb that adds nothing.", FILLERS, "fillers_extra")


@audit("audit-led-spelling")
def led_spelling(c: Corpus) -> DataFrame:
    """In prose the word is spelled in small letters; the first line of a page or the menu counts."""
    texts = audited(c, "audit-led-spelling").select("path", "html").unionByName(c.texts.where(F.col("path") == c.conf["menu"]).select("path", "html"))
    line = F.col("line")
    # pages without the word are dropped before they are split
    lines = texts.where(F.col("html").rlike(LED)).select("path", F.explode(F.split("html", "\n", -1)).alias("line"))
    hit = lines.where(line.rlike(LED) & ~line.contains("<pre") & ~line.contains("<code>") & has_any(line, PROSE_OF_LED))
    return found(hit.select("path").distinct(), "'LED' in prose", severity=WARNING)


@audit("audit-identifier-taal", applies=lambda c: True if c.conf["check"]["audit"]["identifier_words"] else "no identifiers are configured")
def identifier_language(c: Corpus) -> DataFrame:
    """Configured identifiers do not occur outside prose; the first line of a page counts."""
    pattern = r"(^|[^A-Za-z0-9_.])(" + "|".join(c.conf["check"]["audit"]["identifier_words"]) + r")\b"
    lines = audited(c, "audit-identifier-taal", c.lines.where("is_audit")).where(F.col("line").rlike(pattern) & ~has_any(F.col("line"), PROSE_OF_NAMES))
    firsts = lines.groupBy("path").agg(F.min(F.struct("nr", "line")).alias("m")).select("path", "m.*")
    return found(firsts, F.concat(F.lit("identifier: "), F.trim("line")), line="nr", severity=WARNING)


@audit("audit-u-vorm")
def formal_pronoun(c: Corpus) -> DataFrame:
    """No formal second person; each line counts."""
    lines = audited(c, "audit-u-vorm", c.lines.where("is_audit")).where(F.col("line").rlike(FORMAL))
    return found(lines, F.concat(F.lit("formal pronoun: "), F.trim("line")), line="nr", severity=WARNING)


def where_glob(c: Corpus, id: str, key: str) -> DataFrame:
    return audited(c, id).where(tx.any_glob("path", c.conf["check"]["audit"][key]))


@audit("audit-lead")
def has_lead(c: Corpus) -> DataFrame:
    """Pages of the configured patterns have a lead."""
    return found(where_glob(c, "audit-lead", "lead_patterns").where(~F.col("html").contains('class="lead"')), "no lead", severity=WARNING)


@audit("audit-figure")
def figures(c: Corpus) -> DataFrame:
    """An image stands in a figure unless it stands in a table cell; lines are counted."""
    lines = where_glob(c, "audit-figure", "figure_patterns").select("path", F.split("html", "\n", -1).alias("lines"))
    count = lambda test: F.size(F.filter("lines", test))
    rows = lines.select("path", (count(lambda x: x.contains("<img")) - count(lambda x: x.rlike("<t[dh][ >].*<img"))).alias("imgs"), count(lambda x: x.contains("<figure")).alias("figs"))
    return found(rows.where("imgs > figs"), F.format_string("%d images outside tables, %d figures", "imgs", "figs"), severity=WARNING)


def has_exercises(c: Corpus) -> bool | str:
    return True if c.conf["check"]["audit"]["exercise_patterns"] else "no exercise pages are configured"


@audit("audit-indienen", applies=has_exercises)
def submit_section(c: Corpus) -> DataFrame:
    """An exercise has its submission section, and that has its fixed sentence."""
    pages = where_glob(c, "audit-indienen", "exercise_patterns")
    cause = F.when(~F.col("html").rlike('<h2[^>]*id="indienen"'), "no submission section").when(~F.col("html").contains(SUBMIT_SENTENCE), "the submission section is not the fixed one")
    return found(pages.withColumn("cause", cause).where("cause is not null"), F.col("cause"), severity=WARNING)


@audit("audit-oplossing", applies=has_exercises)
def solution_section(c: Corpus) -> DataFrame:
    """An exercise has a solution section."""
    return found(where_glob(c, "audit-oplossing", "exercise_patterns").where(~F.col("html").rlike('<h2[^>]*id="oplossing"')), "no solution section", severity=WARNING)


