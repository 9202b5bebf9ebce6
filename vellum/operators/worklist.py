"""What an import leaves to do, and what report and answer-key rendering start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.kernels import choices_udf, question_lists_udf
from vellum.operators.sequence import text_in_order


def first_and_rest(rows: DataFrame, keys: list[str], order: list[str], text: str, n: int) -> DataFrame:
    """keys, shown (the first n texts), more (how many are left)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_rn", F.row_number().over(w))
    return marked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_rn") <= n, F.struct("_rn", text)))).alias("s"), F.greatest(F.count("*") - n, F.lit(0)).alias("more")).select(*keys, F.transform("s", lambda x: x[text]).alias("shown"), "more")


def staged_pages(topics: DataFrame, contents: DataFrame, key: str = "path", depth: int = 2) -> DataFrame:
    """file, html of each page topic: a header comment with its title and place, and links made relative to its depth."""
    j = topics.where("kind = 'page'").join(contents.select(key, F.col("entry").alias("zip_path"), "html"), [key, "zip_path"])
    place = F.array_join("module", " > ")
    name = F.concat(F.lpad(F.col("ord").cast("string"), 3, "0"), F.lit("-"), tx.slug("title"), F.lit(".html"))
    head = F.concat(F.lit("<!-- "), "title", F.lit(" | "), place, F.when(F.col("hidden"), " | hidden").otherwise(""), F.lit(f" | up {depth} -->\n"))
    return j.select(key, name.alias("file"), F.concat(head, "html").alias("html"), "ord")


def worklist(topics: DataFrame, key: str = "path") -> DataFrame:
    """key, markdown: topics by module in order, as boxes to tick."""
    line = F.concat(F.lit("- [ ] "), "title", F.lit(" ("), "kind", F.lit(")"), F.when(F.col("hidden"), " hidden").otherwise(""), F.lit("\n"))
    rows = topics.withColumn("line", line).withColumn("mod", F.array_join("module", " > "))
    per = rows.groupBy(key, "mod").agg(F.min("ord").alias("ord"), F.concat(F.lit("## "), F.first("mod"), F.lit("\n"), text_in_order("line", ["ord"])).alias("part"))
    return per.groupBy(key).agg(text_in_order("part", ["ord"], "\n").alias("markdown"))


def report_blocks_of(pages: DataFrame) -> DataFrame:
    """path, block: the comments that begin with verslag, in order."""
    return pages.select("path", F.posexplode(F.filter(tx.every("html", tx.COMMENT), lambda b: tx.strip(b).startswith("verslag"))).alias("block_no", "block"))


def render_plan(pages: DataFrame, frame_cm: float = 4.0, tall_cm: float = 9.0) -> DataFrame:
    """path, block_no, nr, kind, height_cm: the blank of each question of a report template.

    Choices get none, a table replaces the frame, a question for a screen shot gets a
    taller one.
    """
    blocks = report_blocks_of(pages)
    lists = blocks.select("path", "block_no", F.explode(question_lists_udf("block")).alias("l"))
    items = lists.select("path", "block_no", F.col("l.begin").alias("b"), F.posexplode("l.items").alias("pos", "i")).select("path", "block_no", (F.col("b") + F.col("pos")).alias("nr"), F.col("i.body").alias("body"))
    rows = items.withColumn("n", F.size(choices_udf("body")))
    kind = F.when(F.col("n") > 0, "choices").when(F.col("body").contains("verslag-tabel"), "table").when(F.lower("body").rlike("screenshot|schermafdruk|schermafbeelding"), "screenshot").otherwise("frame")
    return rows.select("path", "block_no", "nr", kind.alias("kind")).withColumn("height_cm", F.when(F.col("kind") == "screenshot", tall_cm).when(F.col("kind") == "frame", frame_cm))


def answer_key(questions: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """keys, html of each question with its answer below; problems are for reconcile.raise_if_any."""
    j = questions.join(matched.where("problem is null"), keys)
    return j.select(*keys, F.concat(F.lit('<div class="vraag">'), "stem", F.lit('</div><div class="antwoord">'), "answer", F.lit("</div>")).alias("html"))


def overview_notes(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """key, markdown: how often each kind of note occurs, most often first."""
    per = rows.groupBy(key, kind).agg(F.count("*").alias("n"))
    line = F.concat(F.lit("- "), kind, F.lit(": "), F.col("n").cast("string"))
    return per.withColumn("line", line).withColumn("rank", -F.col("n")).groupBy(key).agg(text_in_order("line", ["rank", kind], "\n").alias("markdown"))
