"""Submissions to pseudonymised reports: choice of files, conversion, redaction, overview, change status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.images import image_info_udf
from vellum.operators.privacy import is_empty_template, redacted, text_lines
from vellum.operators.sequence import text_in_order

#: Longest code file that is carried over, in characters.
CODE_CUT = 200_000
#: Smallest side of an image that is kept, widest that is not resized, in pixels.
SMALL, WIDE = 40, 1600
#: Endings of images that are carried over (fixed values).
CONVERTED = (".png", ".jpg", ".jpeg", ".gif", ".bmp")


def without_cover(blocks: DataFrame, key: str = "path", look: int = 20) -> DataFrame:
    """Blocks from the first heading on, if it is among the first `look` blocks, or the next `look`; else all."""
    heads = blocks.where((F.col("kind") == "heading") & (F.col("ord") < 2 * look)).groupBy(key).agg(F.min("ord").alias("_first"))
    return blocks.join(heads, key, "left").where(F.col("ord") >= F.coalesce("_first", F.lit(0))).drop("_first")


def docx_markdown(blocks: DataFrame, key: str = "path") -> DataFrame:
    """key, markdown: headings, bullets, tables row by row, one-cell tables as quotes, ballot boxes as check marks."""
    text = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    text = F.translate(text, "☐☒☑", "□■■")
    tables = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("table_no", F.sum((F.col("kind") == "table").cast("int")).over(tables)).withColumn("t", text)
    size = F.count(F.when(F.col("kind") == "cell", 1)).over(Window.partitionBy(key, "table_no"))
    rows = rows.withColumn("cells", size)
    w = Window.partitionBy(key).orderBy("ord")
    ends = F.coalesce((F.lead("kind").over(w) != "cell") | (F.lead("row").over(w) != F.col("row")), F.lit(True))
    cell = F.when(F.col("cells") == 1, F.concat(F.lit("> "), F.replace("t", F.lit("\n"), F.lit("\n> ")), F.lit("\n"))).otherwise(F.concat(F.lit("| "), tx.squeeze("t"), F.when(ends, " |\n").otherwise(" ")))
    piece = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "t", F.lit("\n")))
        .when(F.col("kind") == "item", F.concat(F.repeat(F.lit("  "), F.coalesce("level", F.lit(0))), F.lit("- "), "t", F.lit("\n")))
        .when(F.col("kind") == "cell", cell)
        .when(F.col("kind") == "image", F.concat(F.lit("![figuur]("), F.coalesce("image", F.lit("")), F.lit(")\n")))
        .when((F.col("kind") == "paragraph") & (F.trim("t") != ""), F.concat("t", F.lit("\n")))
        .otherwise("")
    )
    return rows.withColumn("piece", piece).groupBy(key).agg(text_in_order("piece", ["ord"]).alias("markdown"))


def image_disposition(images: DataFrame, template_hashes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """images(keys, order, sha, ext, width, height) with disposition and number.

    template: only mentioned; small, unsupported, unreadable: left out and counted;
    keep or resize: numbered on within its keys.
    """
    t = template_hashes.select("sha", F.lit(True).alias("in_template")).distinct()
    d = (
        F.when(F.col("in_template"), "template")
        .when(~F.coalesce(F.lower("ext").isin(*CONVERTED), F.lit(False)), "unsupported")
        .when(F.col("width").isNull() | F.col("height").isNull(), "unreadable")
        .when((F.col("width") < SMALL) | (F.col("height") < SMALL), "small")
        .when(F.col("width") > WIDE, "resize")
        .otherwise("keep")
    )
    out = images.join(t, "sha", "left").withColumn("disposition", d)
    kept = F.col("disposition").isin("keep", "resize").cast("int")
    number = F.sum(kept).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("number", F.when(kept == 1, number)).drop("in_template")


def images_of(files: DataFrame, template_hashes: DataFrame, keys: list[str], order: list[str], name: str = "name", content: str = "content") -> DataFrame:
    """files with sha, ext, format, width, height, disposition and number, all from their bytes; the bytes stay behind.

    name_out is what the image is called among its keys: its number, and jpg for a photograph, png for all else.
    """
    info = image_info_udf(content)
    heads = files.withColumn("_i", info).withColumn("sha", F.sha2(F.col(content), 256)).withColumn("ext", tx.extension(name))
    heads = heads.select(*(c for c in files.columns if c != content), "sha", "ext", "_i.format", "_i.width", "_i.height")
    out = image_disposition(heads, template_hashes, keys, order)
    kind = F.when(F.col("ext").isin(".jpg", ".jpeg"), ".jpg").otherwise(".png")
    return out.withColumn("name_out", F.when(F.col("number").isNotNull(), F.concat(F.lpad(F.col("number").cast("string"), F.greatest(F.lit(2), F.length(F.col("number").cast("string"))), F.lit("0")), kind)))


def code_text(c: Column) -> Column:
    return F.when(F.length(c) > CODE_CUT, F.concat(F.substring(c, 1, CODE_CUT), F.lit("\n... (cut)"))).otherwise(c)


def report_order(parts: DataFrame, keys: list[str], has_cover: str, order: list[str]) -> DataFrame:
    """The part with a recognised cover first, the others as they came."""
    return parts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(has_cover), *order)))


def reports(parts: DataFrame, patterns: list[str], template: list[str], by: str = "[naam]") -> DataFrame:
    """code, text, n_names, n_images, n_code, empty of parts(code, place, kind, name, text, n_images).

    Names go from texts and from file names; a report whose lines are all the
    template's, without an image of its own, is empty.  template: the lines of one document.
    """
    body, n = redacted(F.col("text"), patterns, by)
    title, m = redacted(F.col("name"), patterns, by)
    rows = parts.withColumn("n", n + m).withColumn("piece", F.concat(F.lit("## "), title, F.lit("\n\n"), F.when(F.col("kind") == "code", code_text(body)).otherwise(body))).withColumn("lines", text_lines(body))
    per = rows.groupBy("code").agg(text_in_order("piece", ["place"], "\n\n").alias("text"), F.sum("n").alias("n_names"), F.sum("n_images").alias("n_images"), F.count_if(F.col("kind") == "code").alias("n_code"), F.flatten(F.collect_list("lines")).alias("lines"))
    known = F.array(*map(F.lit, template)) if template else F.expr("cast(array() as array<string>)")
    return per.select("code", "text", "n_names", "n_images", "n_code", is_empty_template(F.col("lines"), known, F.col("n_images")).alias("empty"))


def overview(report_rows: DataFrame, status: DataFrame, n_students: int) -> DataFrame:
    """A line of the overview for each report: code, images, code files, names replaced, status."""
    j = report_rows.join(status.select("code", "status"), "code", "left")
    line = F.concat(F.lit("| "), "code", F.lit(" | "), F.col("n_images").cast("string"), F.lit(" | "), F.col("n_code").cast("string"), F.lit(" | "), F.col("n_names").cast("string"), F.lit(" | "), F.when(F.col("empty"), "empty template").otherwise(F.coalesce("status", F.lit(""))), F.lit(" |"))
    return j.select("code", line.alias("line")).withColumn("n_students", F.lit(n_students))


def publish(review: DataFrame, keymap: DataFrame, footer: str) -> DataFrame:
    """student_id, text, kind of reviewed rows: what goes out, with the footer below what was judged."""
    from vellum.operators.reconcile import decision

    j = review.join(keymap.select("code", "student_id"), "code", "left")
    kind, text = decision(F.col("voorstel"), F.col("feedback"), footer)
    return j.select("student_id", "code", kind.alias("kind"), text.alias("text")).where("kind <> 'empty'")


def with_header(sheet: DataFrame, wanted: list[str]) -> DataFrame:
    """A sheet whose header is exactly the wanted one; else an error that names both."""
    if sheet.columns != wanted:
        raise ValueError(f"the header is {sheet.columns}, wanted {wanted}")
    return sheet
