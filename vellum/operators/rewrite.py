"""Rewrites of imported and exported markup that need several columns or a lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.tokens import TEXTS, PrintTexts, references_udf, spliced_udf
from vellum.plans.gate import gated


def references(pages: DataFrame, key: str = "path", html: str = "html") -> DataFrame:
    """key, tag, attr, ref, alt and spans of each href and src of a page's tags, entities decoded."""
    return pages.select(key, F.explode(references_udf(html)).alias("r")).select(key, "r.*")


def spliced(pages: DataFrame, edits: DataFrame, key: str, html: str) -> DataFrame:
    """pages with the spans of edits(key, begin, end, new) replaced; the rest of a page stays byte for byte."""
    per = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("begin", "end", "new"))).alias("_edits"))
    return pages.join(per, key, "left").withColumn(html, spliced_udf(html, "_edits")).drop("_edits")


def rewrite_references(pages: DataFrame, resolved: DataFrame, key: str = "path", html: str = "html") -> DataFrame:
    """pages with each href and src of a tag replaced by what resolved(key, ref, new) says; others stay.

    Names in comments, scripts and plain text are no references.
    """
    found = references(pages, key, html).join(resolved.select(key, "ref", "new"), [key, "ref"])
    return spliced(pages, found.select(key, "begin", "end", as_value(F.col("new")).alias("new")), key, html)


def as_value(new: Column) -> Column:
    """An attribute's new value between the quotes it has; in quotes of its own where it had none."""
    safe = F.replace(tx.escape(new, True), F.lit("'"), F.lit("&#39;"))
    return F.when(F.col("quote") == "", F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(safe)


#: What a platform makes of a code block: a code element for each line within one (fixed shape).
SPLIT_BLOCK = r"(?s)<pre>\s*<code[^>]*>((?:\s*<code>(?:(?!</code>).)*+</code>)++)\s*</code>\s*</pre>"


def joined_code_blocks(content: Column | str) -> Column:
    """Code blocks that were cut into a code element for each line, as one pre with line ends; other blocks stay."""
    content = tx.col(content)
    gaps, inner = F.split(content, SPLIT_BLOCK, -1), tx.every(content, SPLIT_BLOCK, 1)
    joined = F.transform(inner, lambda x: F.concat(F.lit("<pre>"), F.array_join(tx.every(x, r"(?s)<code>(.*?)</code>", 1), "\n"), F.lit("</pre>")))
    return F.when(F.size(inner) > 0, F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.try_element_at(joined, i + 1), F.lit("")))), "")).otherwise(content)


def code_block_repairs(rows: DataFrame, id: str, content: str) -> DataFrame:
    """id, content: only the rows that the repair changes."""
    return rows.withColumn("_new", joined_code_blocks(F.col(content))).where(F.col("_new") != F.col(content)).select(id, F.col("_new").alias(content))


def image_outcomes(pages: DataFrame, files: DataFrame, key: str = "path", html: str = "html") -> DataFrame:
    """key, target, missing, alt and spans of each image of a page that is a file of its own."""
    images = references(pages, key, html).where("tag = 'img' and attr = 'src' and ref <> ''").where(~F.col("ref").rlike("^(http|data:|file:)"))
    there = files.select(F.col("path").alias("target"), F.lit(True).alias("there")).distinct()
    j = images.withColumn("target", tx.local_target(key, "ref")).join(there, "target", "left")
    return j.select(key, "target", F.col("there").isNull().alias("missing"), "alt", "quote", "begin", "end", "tag_begin", "tag_end")


def images_or_placeholder(pages: DataFrame, files: DataFrame, key: str = "path", html: str = "html", root: str = "", texts: PrintTexts = TEXTS) -> DataFrame:
    """pages with images by their path from the root; one that is missing becomes a block with its alternative text, listed in `missing`."""
    found = image_outcomes(pages, files, key, html)
    block = F.concat(F.lit(f'<div class="pdf-missing-img"><strong>{texts.no_image}</strong><br>'), tx.escape(F.coalesce(F.nullif("alt", F.lit("")), F.lit(texts.no_alt)), True), F.lit("</div>"))
    edits = found.select(key, F.when(F.col("missing"), F.col("tag_begin")).otherwise(F.col("begin")).alias("begin"), F.when(F.col("missing"), F.col("tag_end")).otherwise(F.col("end")).alias("end"), F.when(F.col("missing"), block).otherwise(as_value(F.concat(F.lit(root), "target"))).alias("new"))
    lost = found.where("missing").groupBy(key).agg(F.array_sort(F.collect_set("target")).alias("missing"))
    return spliced(pages, edits, key, html).join(lost, key, "left")


def absolute_references(pages: DataFrame, files: DataFrame | None, key: str = "path", html: str = "html", root: str = "") -> DataFrame:
    """pages with each relative href and src as its path from the root, behind `root`; addresses, anchors and data stay.

    With files, each reference must lead to one of them: all that do not are told
    together (gate.Invalid) before any page is handed on.  Without, none is looked at.
    """
    found = references(pages, key, html).where(~F.col("ref").rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:|//|#|$)"))
    found = found.withColumn("target", tx.local_target(key, "ref"))
    if files is not None:
        there = files.select(F.col("path").alias("target"), F.lit(True).alias("_there")).distinct()
        found = found.join(there, "target", "left")
        found = gated(found, {"references to nothing": F.col("_there").isNull()}, F.concat(F.col(key), F.lit(": "), "ref"))
    tail = F.regexp_extract("ref", r"([?#].*)$", 1)
    return spliced(pages, found.select(key, "begin", "end", as_value(F.concat(F.lit(root), "target", tail)).alias("new")), key, html)


def replace_section(log: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    """A log by sections with those of new put in; other sections stay."""
    return new.select(key, body).unionByName(log.join(new.select(key), key, "left_anti").select(key, body))
