"""Answer files and proposals: keyed blocks of text, and their match with the questions they answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.sequence import kth_to_kth, text_in_order
from vellum.plans.gate import gated

#: A heading that opens a block: question number, frame or section.
KEY = r"^##\s+(?:(?i)(vraag|kader|sectie))\s*:?\s*(.*?)\s*$"


def answer_blocks(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, ord, kind, name, body of each block; fenced lines open no block; text before the first block is kind null."""
    lines = files.select(key, F.posexplode(F.split(text, "\r?\n", -1)).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike("^\\s*```").cast("int")
    marked = lines.withColumn("fences", F.sum(fence).over(upto)).withColumn("opens", (F.col("line").rlike(KEY) & (F.col("fences") % 2 == 0)))
    numbered = marked.withColumn("ord", F.sum(F.col("opens").cast("int")).over(upto))
    heads = numbered.where("opens").select(key, "ord", F.lower(F.regexp_extract("line", KEY, 1)).alias("kind"), tx.squeeze(F.regexp_extract("line", KEY, 2)).alias("name"))
    body = numbered.where(~F.col("opens")).groupBy(key, "ord").agg(tx.strip(text_in_order("line", ["pos"], "\n")).alias("body"))
    return heads.join(body, [key, "ord"], "full_outer").select(key, "ord", "kind", "name", F.coalesce("body", F.lit("")).alias("body"))


def match_answers(wanted: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, answer, problem: each wanted key has one answer and each answer is wanted; both failures are rows."""
    b = blocks.groupBy(*keys).agg(F.count("*").alias("n"), F.min("body").alias("answer"))
    j = wanted.select(*keys, F.lit(True).alias("is_wanted")).join(b, keys, "full_outer")
    problem = F.when(F.col("n").isNull(), "no answer").when(F.col("is_wanted").isNull(), "answers nothing").when(F.col("n") > 1, "answered twice")
    return j.select(*keys, "answer", problem.alias("problem"))


def all_matched(matched: DataFrame, name: str) -> DataFrame:
    """matched, if nothing is wrong with it; else all problems together, by kind, numbers first in their order (gate.Invalid)."""
    number = F.col(name).try_cast("int")
    checks = {p: F.col("problem") == p for p in ("no answer", "answers nothing", "answered twice")}
    return gated(matched, checks, F.col(name).cast("string"), F.struct(number.isNull(), number, F.col(name)))


def leftovers(matched: DataFrame, name: str) -> DataFrame:
    """Unused answers, numbers first in their order, then names."""
    number = F.col(name).try_cast("int")
    return matched.where("problem = 'answers nothing'").orderBy(number.isNull(), number, name)


def filled_rows(rows: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Table rows with the values of the first unused answer line of their label, k-th to k-th; problems are told.

    rows(keys, row, label, n_cells), lines(keys, pos, line as label: value).
    """
    pairs = lines.withColumn("lv", tx.label_value("line")).where("lv is not null").select(*keys, "pos", tx.squeeze("lv.label").alias("label"), F.col("lv.value").alias("value"))
    j = kth_to_kth(rows, pairs, "label", ["row"], ["pos"], keys).withColumn("values", tx.row_values("value"))
    problem = F.when(F.col("pos").isNull(), "no line for the row").when(F.col("row").isNull(), "a line for no row").when(F.size("values") != F.col("n_cells"), "another number of values")
    return j.withColumn("problem", problem)


def answer_parts(bodies: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """keys, ord, kind, text, options: paragraphs, fences and figure lines of an answer's body.

    A figure line is `![path]` with options page=, crop= or width= in braces; a line
    that begins like one and does not read as one is kind error.
    """
    lines = bodies.select(*keys, F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    w = Window.partitionBy(*keys).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike("^\\s*```")
    lines = lines.withColumn("n", F.sum(fence.cast("int")).over(upto)).withColumn("in_fence", (F.col("n") % 2 == 1) & ~fence)
    figure = r"^!\[([^\]]+)\](?:\{((?:\s*(?:page|crop|width)=[\d.,]+)*)\s*\})?\s*$"
    kind = F.when(fence, "fence-mark").when(F.col("in_fence"), "fence").when(F.col("line").rlike(figure), "figure").when(F.col("line").startswith("!["), "error").when(F.trim("line") == "", "blank").otherwise("paragraph")
    marked = lines.withColumn("kind", kind)
    new = F.coalesce((F.col("kind") != F.lag("kind").over(w)) | F.col("kind").isin("figure", "error"), F.lit(True)).cast("int")
    grouped = marked.withColumn("ord", F.sum(new).over(upto)).where(~F.col("kind").isin("blank", "fence-mark"))
    options = F.str_to_map(F.regexp_extract(F.first("line"), figure, 2), F.lit(r"\s+"), F.lit("="))
    return grouped.groupBy(*keys, "ord", "kind").agg(text_in_order("line", ["pos"], "\n").alias("text"), F.when(F.first("kind") == "figure", F.map_filter(options, lambda k, v: k != "")).alias("options"))


#: A section's heading, the line that opens a note, and what a section without text says (fixed values).
SECTION, NOTE, NOTHING = r"## (S\d+)[ \t]*\n", "Voor de lector:", "De lector stuurde niets."


def _sections(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, part, code, body, note: a proposals file cut before each section; what precedes them has no code."""
    parts = files.select(key, F.posexplode(F.split(text, rf"(?m)^(?={SECTION})", -1)).alias("ord", "part")).withColumn("code", tx.first("part", rf"^{SECTION}"))
    inner = tx.strip(F.regexp_replace("part", rf"^{SECTION}", ""))
    noted = rf"(?ms)^{NOTE}\s*(.*?)\s*\z"
    body = F.when(inner.rlike(noted), tx.strip(F.regexp_replace(inner, noted, ""))).otherwise(inner)
    return parts.select(key, "ord", "part", "code", body.alias("body"), tx.strip(F.regexp_extract(inner, noted, 1)).alias("note"))


def proposals(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, ord, code, proposal, note of a proposals file: a section for each code, a note behind its mark."""
    return _sections(files, key, text).where("code is not null").select(key, (F.col("ord") - 1).alias("ord"), "code", F.col("body").alias("proposal"), "note")


def written_back(files: DataFrame, new: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """The proposals file with the texts of new(code, proposal) put in; `changed` lists the codes whose section differs.

    A section that says the same but for white space, and one that new does not name, stays
    byte for byte; notes stay.  An empty text becomes a section without one, whose note
    begins with what says that nothing is sent.
    """
    parts = _sections(files, key, text)
    j = parts.join(new.select("code", tx.strip(F.regexp_replace(F.coalesce("proposal", F.lit("")), "\r\n", "\n")).alias("_new")), "code", "left")
    note = F.when((F.col("_new") == "") & ~F.col("note").startswith(NOTHING), F.trim(F.concat(F.lit(NOTHING + " "), "note"))).otherwise(F.col("note"))
    pieces = F.array(F.concat(F.lit("## "), "code", F.lit("\n")), F.when(F.col("_new") != "", F.concat("_new", F.lit("\n"))), F.when(note != "", F.concat(F.lit(NOTE + " "), note, F.lit("\n"))))
    section = F.concat(F.array_join(F.filter(pieces, lambda p: p.isNotNull()), "\n"), F.lit("\n"))
    differs = F.col("_new").isNotNull() & (tx.squeeze(section) != tx.squeeze("part"))
    j = j.withColumn("_part", F.when(differs, section).otherwise(F.col("part"))).withColumn("_code", F.when(differs, F.col("code")))
    return j.groupBy(key).agg(text_in_order("_part", ["ord"]).alias(text), F.array_sort(F.collect_list("_code")).alias("changed"))


def review_sheet(proposed: DataFrame, keymap: DataFrame) -> DataFrame:
    """naam, code, voorstel, feedback, noot, al_feedback sorted by name; a code without name is a row with null naam, see reconcile.raise_if_any."""
    j = proposed.join(keymap.select("code", F.col("name").alias("naam")), "code", "left")
    return j.select("naam", "code", F.col("proposal").alias("voorstel"), F.col("proposal").alias("feedback"), F.col("note").alias("noot"), F.lit(None).cast("string").alias("al_feedback")).orderBy(F.lower("naam"), "code")


def name_mismatches(sheet: DataFrame, keymap: DataFrame) -> DataFrame:
    """Sheet rows whose name is not the key map's for their code."""
    j = sheet.join(keymap.select("code", F.col("name").alias("known")), "code", "left")
    return j.where(~F.col("naam").eqNullSafe(F.col("known"))).select("code", "naam", "known")
