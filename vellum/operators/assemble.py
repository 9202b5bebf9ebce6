"""Assembly of bundles, chapters, handouts and question packages as ordered rows."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.kernels import choices_udf, drop_solutions_udf, lazy_udf, question_lists_udf, unescape_udf, xhtml_udf
from vellum.functions.tokens import frames_to_links_udf, printable_udf, without_scripts_udf
from vellum.operators.privacy import item_hash
from vellum.operators.sequence import nested_headings, text_in_order
from vellum.plans.gate import gated

# ---------------------------------------------------------------- pages of a bundle


def body_of(c: Column | str) -> Column:
    """What is inside body, else all of it."""
    c = tx.col(c)
    return F.coalesce(tx.first(c, r"(?is)<body[^>]*>(.*)</body>"), c)


def container_of(c: Column | str, mark: str = "container") -> Column:
    """What is inside the container, up to the last closing div of the body; else the body."""
    body = body_of(c)
    return F.coalesce(tx.first(body, rf'(?is)<div[^>]*class="[^"]*\b{mark}\b[^"]*"[^>]*>(.*)</div>'), body)


def without_scripts(c: Column | str) -> Column:
    """Scripts out; one that shows something of its own leaves a note."""
    return without_scripts_udf(tx.col(c))["html"]


def frames_to_links(c: Column | str) -> Column:
    """Frames become links to what they show."""
    return frames_to_links_udf(tx.col(c))


def printable(c: Column | str) -> Column:
    """struct(html, error): a sheet's own content: no scripts, heading, intro, downloads; links unwrapped."""
    return printable_udf(tx.col(c))


def page_links(pages: DataFrame, in_bundle: DataFrame, files: DataFrame) -> DataFrame:
    """path, href, target, outcome of each link: anchor (a page of the bundle), file, unresolved or outside.

    The bundle is matched in any case, as the readers of a bundle do not tell cases apart.
    """
    links = pages.select("path", F.explode(tx.every("html", r'(?is)<a\b[^>]*\bhref="([^"#][^"]*)"')).alias("href"))
    outside = F.col("href").rlike(r"^(?i)(?:[a-z][a-z0-9+.-]*:|//)")
    links = links.withColumn("target", F.when(~outside, tx.local_target("path", "href"))).withColumn("low", F.lower("target"))
    bundle = in_bundle.select(F.lower("path").alias("low"), F.lit(True).alias("in_bundle")).distinct()
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("is_file"))
    j = links.join(bundle, "low", "left").join(known, "target", "left")
    return j.select("path", "href", "target", F.when(F.col("target").isNull(), "outside").when(F.col("in_bundle"), "anchor").when(F.col("is_file"), "file").otherwise("unresolved").alias("outcome"))


def page_transform(pages: DataFrame, keep_solutions: bool = True) -> DataFrame:
    """path, fragment: body, scripts, solutions, frames, then ids; ids come before links are rewritten."""
    c = without_scripts(body_of("html"))
    c = c if keep_solutions else drop_solutions_udf(c)
    return pages.select("path", tx.prefix_ids(frames_to_links(c), tx.slug("path")).alias("fragment"))


def item_list(menu_rows: DataFrame, exercise_folder: str = "Exercises", exercises_first: bool = False, reference_only: bool = False, doc_exts: tuple[str, ...] = (".pdf", ".zip", ".docx", ".pptx", ".xlsx")) -> DataFrame:
    """Pages and documents of a module in order: path, module, category, is_exercise, kind, ord."""
    rows = menu_rows.where(F.col("kind").isin("page", "file") & F.col("target").isNotNull())
    exercise = tx.has_part("target", [exercise_folder], folders_only=True)
    kind = F.when(tx.extension("target").isin(*doc_exts), "document").otherwise("page")
    out = rows.select(F.col("target").alias("path"), F.element_at("module_path", 1).alias("module"), F.array_join(F.slice("module_path", F.lit(2), F.size("module_path")), " > ").alias("category"), exercise.alias("is_exercise"), kind.alias("kind"), "title", "ord")
    out = out.where(~F.col("is_exercise")) if reference_only else out
    first = F.col("is_exercise") if exercises_first else ~F.col("is_exercise")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("module").orderBy(F.desc(first), "ord")))


def select_modules(modules: DataFrame, key: str | None) -> DataFrame:
    """All modules, or the one with this id or leading number."""
    return modules if key is None else modules.where((F.col("id") == key) | (F.regexp_extract("title", r"^(\d+)\.", 1) == key))


def lab_number(path: Column | str, folder: str = "Labo") -> Column:
    return tx.first(path, rf"^{folder}([0-9]+)/")


def bundle(items: DataFrame, fragments: DataFrame, group: str = "module") -> DataFrame:
    """group, toc, html: each group's fragments in order, below a table of contents."""
    j = items.where("kind = 'page'").join(fragments, "path")
    entry = F.concat(F.lit('<li><a href="#'), tx.slug("path"), F.lit('">'), tx.escape("title"), F.lit("</a></li>"))
    section = F.concat(F.lit('<section id="'), tx.slug("path"), F.lit('">'), F.col("fragment"), F.lit("</section>"))
    rows = j.withColumn("entry", entry).withColumn("section", section)
    return rows.groupBy(group).agg(text_in_order("entry", ["place"]).alias("toc"), text_in_order("section", ["place"]).alias("html"))


def sheet_of(target: Column | str) -> Column:
    """struct(folder, page, pdf) of a sheet, named by its folder or by its page."""
    t = F.regexp_replace(tx.col(target), "/+$", "")
    is_page, above = t.endswith(".html"), tx.parent(t)
    folder = F.when(~is_page, t).when(tx.basename(above) == "Theorie", tx.parent(above)).otherwise(above)
    page = F.when(is_page, t).otherwise(F.concat(t, F.lit("/Theorie/Spiekblad.html")))
    return F.struct(folder.alias("folder"), page.alias("page"), F.concat(F.replace(folder, F.lit("/"), F.lit("-")), F.lit("-spiekblad.pdf")).alias("pdf"))


def lab_title(overview: Column | str) -> Column:
    """The heading of a lab's overview page as text, without the word Labo before it; null without a heading."""
    return F.regexp_replace(tx.strip(unescape_udf(F.regexp_replace(tx.first(overview, r"(?s)<h1[^>]*>(.*?)</h1>"), tx.TAG, ""))), r"^Labo\s+", "")


def subtitle(n_exercises: Column, n_other: Column, with_solutions: bool) -> Column:
    base = F.when((n_exercises > 0) & (n_other > 0), "Theory and exercises").when(n_exercises > 0, "Exercises").otherwise("Theory")
    return F.concat(base, F.lit(" with solutions")) if with_solutions else base


# ---------------------------------------------------------------- slides


def slides(decks: DataFrame) -> DataFrame:
    """path, pos, number, html of each slide; the number is its data-slide, else its position."""
    rows = decks.select("path", F.posexplode(tx.every("html", r'(?s)(<section class="slide.*?</section>)')).alias("p", "html"))
    no = F.coalesce(tx.first("html", r'data-slide="(\d+)"').cast("int"), F.col("p") + 1)
    return rows.select("path", (F.col("p") + 1).alias("pos"), no.alias("number"), "html")


def handout(slide_rows: DataFrame, title: str) -> DataFrame:
    """path, html: a row for each slide with its number, the slide and room for notes."""
    row = F.concat(F.lit('<tr><td class="nr">'), F.col("number").cast("string"), F.lit('</td><td class="slide">'), F.col("html"), F.lit('</td><td class="notes"></td></tr>'))
    return slide_rows.withColumn("row", row).groupBy("path").agg(F.concat(F.lit(f"<h1>{title}</h1><table>"), text_in_order("row", ["pos"]), F.lit("</table>")).alias("html"))


def reading_order(figures: DataFrame, keys: list[str]) -> DataFrame:
    """place of figures(keys, ord, x, y, height): by y if no two share a height range, else by x."""
    a = figures.select(*keys, F.col("ord").alias("o1"), F.col("y").alias("y1"), (F.col("y") + F.col("height")).alias("e1"))
    b = figures.select(*keys, F.col("ord").alias("o2"), F.col("y").alias("y2"), (F.col("y") + F.col("height")).alias("e2"))
    beside = a.join(b, keys).where("o1 < o2 and y1 < e2 and y2 < e1").select(*keys).distinct().withColumn("beside", F.lit(True))
    j = figures.join(beside, keys, "left")
    return j.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(F.col("beside"), F.col("x")).otherwise(F.col("y")), "ord"))).drop("beside")


def nested_list(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, html: nested ul of items(keys, ord, level, text), a fold over the levels."""
    rows = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("level").cast("int").alias("level"), "text"))).alias("xs"))
    step = lambda a, x: F.struct(
        x["level"].alias("level"),
        F.concat(
            a["html"],
            F.when(x["level"] > a["level"], F.repeat(F.lit("<ul>"), x["level"] - a["level"])).when(x["level"] < a["level"], F.concat(F.lit("</li>"), F.repeat(F.lit("</ul></li>"), a["level"] - x["level"]))).otherwise("</li>"),
            F.lit("<li>"),
            tx.escape(x["text"]),
        ).alias("html"),
    )
    start = F.struct(F.lit(-1).alias("level"), F.lit("").alias("html"))
    done = lambda a: F.concat(a["html"], F.lit("</li>"), F.repeat(F.lit("</ul></li>"), a["level"]), F.lit("</ul>"))
    return rows.select(*keys, F.aggregate("xs", start, step, done).alias("html"))


# ---------------------------------------------------------------- documents


def header_reason(rows: DataFrame, keys: list[str], styled: Column) -> DataFrame:
    """keys, is_header, reason: whether the first row of a table is a header, and why or why not.

    It is if marked as one (flag), if each of its cells with text is all bold (bold), or if
    the table's style sets it off (style: from two columns and three rows on).  Else the
    table has one column, or no signal.  rows(keys, row, col, all_bold, header, text).
    """
    top, text = F.col("row") == 0, F.trim("text") != ""
    per = rows.groupBy(*keys).agg(F.max(F.when(top, F.col("col"))).alias("c"), F.max("row").alias("r"), F.bool_or(F.col("header") & top).alias("flag"), F.bool_and(F.when(top & text, F.col("all_bold"))).alias("bold"), F.bool_or(styled).alias("styled"))
    reason = F.when(F.col("flag"), "flag").when(F.col("bold"), "bold").when(F.col("styled") & (F.col("c") > 0) & (F.col("r") > 1), "style").when(F.col("c") > 0, "no signal").otherwise("one column")
    return per.withColumn("reason", reason).select(*keys, F.col("reason").isin("flag", "bold", "style").alias("is_header"), "reason")


def fully_bold(runs: Column) -> Column:
    """Whether every run with text is bold, and there is one: bold is then layout, not stress."""
    shown = F.filter(runs, lambda r: F.trim(r["text"]) != "")
    return (F.size(shown) > 0) & F.forall(shown, lambda r: r["bold"])


def column_widths(twips: Column) -> Column:
    """Millimetres of a table's columns; none at all if one of them is no whole number.

    The double is rounded after it is multiplied by ten, as databases do: 107.94999999999999 (6120) has 1079.5 tenths.
    """
    whole = F.forall(twips, lambda w: F.coalesce(w.rlike("^[0-9]+$"), F.lit(False)))
    return F.when(whole, F.transform(twips, lambda w: F.round(w.cast("long") / 1440 * 25.4 * 10) / 10)).otherwise(F.expr("cast(array() as array<double>)"))


def empty_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, col: columns without any text, in tables of two columns or more."""
    n = F.max("col").over(Window.partitionBy(*keys))
    per = cells.withColumn("last", n).groupBy(*keys, "col", "last").agg(F.bool_and(F.trim("text") == "").alias("empty"))
    return per.where("empty and last >= 1").select(*keys, "col")


def docx_sections(blocks: DataFrame, key: str = "path") -> DataFrame:
    """Blocks with chapter_no and section_no from headings of level 1 and 2, and the section's title."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("kind") == "heading", F.col("level"))
    text = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    out = blocks.withColumn("chapter_no", F.sum((F.coalesce(level, F.lit(0)) == 1).cast("int")).over(w)).withColumn("title", F.last(F.when(level <= 2, text), ignorenulls=True).over(w))
    w2 = Window.partitionBy(key, "chapter_no").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("section_no", F.sum((F.coalesce(level, F.lit(0)) == 2).cast("int")).over(w2))


def run_html(runs: Column, plain_bold: Column | bool = False) -> Column:
    """Markup of formatted runs; plain_bold drops bold where all is bold."""
    plain = F.lit(plain_bold) if isinstance(plain_bold, bool) else plain_bold

    def one(r):
        t = tx.escape(r["text"])
        t = F.when(r["bold"] & ~plain & (F.trim(r["text"]) != ""), F.concat(F.lit("<strong>"), t, F.lit("</strong>"))).otherwise(t)
        t = F.when(r["italic"] & (F.trim(r["text"]) != ""), F.concat(F.lit("<em>"), t, F.lit("</em>"))).otherwise(t)
        return F.when(r["link"].isNotNull(), F.concat(F.lit('<a href="'), tx.escape(r["link"], True), F.lit('">'), t, F.lit("</a>"))).otherwise(t)

    return F.array_join(F.transform(runs, one), "")


def docx_html(blocks: DataFrame, key: str = "path", offset: int = 0) -> DataFrame:
    """key, chapter_no, section_no, title, html: sections as markup; numbered lists go on where their numbering id left off."""
    rows = docx_sections(blocks, key).where("kind <> 'table' and kind <> 'cell' or row = 0 and col = 0 or row is not null")
    w = Window.partitionBy(key).orderBy("ord")
    count = F.sum((F.col("kind") == "item").cast("int")).over(Window.partitionBy(key, "num_id", "level").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("nth", count).withColumn("prev", F.lag("kind").over(w)).withColumn("prev_num", F.lag("num_id").over(w)).withColumn("next", F.lead("kind").over(w)).withColumn("next_num", F.lead("num_id").over(w)).withColumn("next_row", F.lead("row").over(w))
    tag = F.when(F.col("num_format").isin("bullet", "none") | F.col("num_format").isNull(), "ul").otherwise("ol")
    text = run_html(F.col("runs"))
    opens = ~((F.col("prev") == "item") & F.col("prev_num").eqNullSafe(F.col("num_id")))
    closes = ~((F.col("next") == "item") & F.col("next_num").eqNullSafe(F.col("num_id")))
    start = F.when((tag == "ol") & (F.col("nth") > 1), F.concat(F.lit(' start="'), F.col("nth").cast("string"), F.lit('"'))).otherwise("")
    item = F.concat(F.when(F.coalesce(opens, F.lit(True)), F.concat(F.lit("<"), tag, start, F.lit(">"))).otherwise(""), F.lit("<li>"), text, F.lit("</li>"), F.when(F.coalesce(closes, F.lit(True)), F.concat(F.lit("</"), tag, F.lit(">"))).otherwise(""))
    h = F.least(F.col("level") + offset, F.lit(6)).cast("string")
    span = lambda n, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {n}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    cell_tag = F.when(F.col("header"), "th").otherwise("td")
    first_cell = F.coalesce(F.col("prev") != "cell", F.lit(True))
    last_cell = F.coalesce(F.col("next") != "cell", F.lit(True))
    new_row = first_cell | (F.lag("row").over(w) != F.col("row"))
    ends_row = last_cell | (F.col("next_row") != F.col("row"))
    cell = F.concat(F.when(first_cell, "<table>").otherwise(""), F.when(new_row, "<tr>").otherwise(""), F.lit("<"), cell_tag, span("colspan", "col_span"), span("rowspan", "row_span"), F.lit(">"), text, F.lit("</"), cell_tag, F.lit(">"), F.when(ends_row, "</tr>").otherwise(""), F.when(last_cell, "</table>").otherwise(""))
    image = F.concat(F.lit('<figure><img src="'), F.coalesce("image", F.lit("")), F.lit('" alt=""></figure>'))
    html = F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), h, F.lit(">"), text, F.lit("</h"), h, F.lit(">"))).when(F.col("kind") == "item", item).when(F.col("kind") == "cell", cell).when(F.col("kind") == "image", image).when((F.col("kind") == "paragraph") & (F.trim(text) != ""), F.concat(F.lit("<p>"), text, F.lit("</p>"))).otherwise("")
    marked = rows.withColumn("html", html)
    return marked.groupBy(key, "chapter_no", "section_no", "title").agg(text_in_order("html", ["ord"]).alias("html"))


def slide_html(shapes: DataFrame, key: str = "path") -> DataFrame:
    """key, slide, kind, html: a section for each slide; the layout's name tells a title slide."""
    kind = F.when(F.lower(F.coalesce(F.max("layout"), F.lit(""))).rlike("title slide|titel|section"), "title").otherwise("content")
    shown = shapes.where(~((F.col("kind") == "text") & F.coalesce("placeholder", F.lit("")).isin("sldNum", "dt", "ftr")))
    text = tx.escape(F.coalesce("text", F.lit("")))
    piece = F.when(F.col("kind") == "title", F.concat(F.lit("<h2>"), text, F.lit("</h2>"))).when(F.col("kind") == "text", F.concat(F.lit("<p>"), text, F.lit("</p>"))).when(F.col("kind") == "row", F.concat(F.lit("<p class='row'>"), text, F.lit("</p>"))).when(F.col("kind") == "picture", F.concat(F.lit('<img src="'), F.coalesce("image", F.lit("")), F.lit('">'))).otherwise(F.concat(F.lit('<aside class="notes">'), text, F.lit("</aside>")))
    rows = shown.withColumn("piece", piece).groupBy(key, "slide").agg(kind.alias("kind"), text_in_order("piece", ["ord"]).alias("pieces"))
    return rows.select(key, "slide", "kind", F.concat(F.lit('<section class="slide '), "kind", F.lit('">'), "pieces", F.lit("</section>")).alias("html"))


# ---------------------------------------------------------------- questions


CORRECT = r'class="[^"]*\bjuist\b'


def question_rows(pages: DataFrame) -> DataFrame:
    """path, nr, stem, choices(body, correct), n_correct, answer, status: ok, open (left out with a note) or an error.

    Choices are kept whole; the stem is what comes before them, without the answer.
    """
    lists = pages.withColumn("html", tx.without_comments("html")).select("path", F.explode(question_lists_udf("html")).alias("l"))
    items = lists.select("path", F.col("l.begin").alias("begin"), F.posexplode("l.items").alias("pos", "i")).select("path", (F.col("begin") + F.col("pos")).alias("nr"), F.col("i.tag").alias("tag"), F.col("i.body").alias("body"))
    rows = items.withColumn("cs", choices_udf("body")).withColumn("choices", F.transform("cs", lambda x: F.struct(F.trim(x["body"]).alias("body"), x["tag"].rlike(CORRECT).alias("correct"))))
    answer = F.nullif(F.trim(F.regexp_extract("body", r'(?s)<div class="oplossing">(.*?)</div>', 1)), F.lit(""))
    stem = F.trim(F.regexp_replace(F.regexp_replace("body", r"(?s)<ul\b.*</ul>", ""), r'(?s)<div class="oplossing">.*?</div>', ""))
    n = F.size(F.filter("choices", lambda c: c["correct"]))
    status = F.when(F.size("choices") == 0, "open").when(n != 1, "error: correct choices").when(F.size("choices") > 26, "error: too many choices").when(stem == "", "error: no stem").otherwise("ok")
    return rows.select("path", "nr", "tag", stem.alias("stem"), "choices", n.alias("n_correct"), answer.alias("answer"), status.alias("status"))


def question_groups(pages: DataFrame) -> DataFrame:
    """path, nr, outer_heading, inner_heading: the nearest h2 and h3 above each question; h3 ends at the next h2."""
    marks = pages.select("path", F.posexplode(tx.every(tx.without_comments("html"), r'(?is)(<h[23]\b[^>]*>.*?</h[23]>|<ol\b[^>]*class="[^"]*\bvragen\b[^>]*>)')).alias("pos", "m"))
    outer, inner = (F.when(F.col("m").rlike(rf"(?i)^<h{n}"), tx.strip_tags("m")) for n in (2, 3))
    placed = nested_headings(marks, ["path"], ["pos"], outer, inner).where(F.col("m").rlike("(?i)^<ol"))
    nth = placed.withColumn("list_no", F.row_number().over(Window.partitionBy("path").orderBy("pos")))
    lists = pages.select("path", F.explode(question_lists_udf(tx.without_comments("html"))).alias("l")).select("path", "l.list_no", "l.begin", F.size("l.items").alias("n")).where("n > 0")
    return lists.join(nth, ["path", "list_no"]).select("path", F.explode(F.sequence("begin", F.col("begin") + F.col("n") - 1)).alias("nr"), "outer_heading", "inner_heading")


def missing_sources(pages: DataFrame, files: DataFrame) -> DataFrame:
    """path, nr, source of the sources that questions name in data-bron and that are no file of the corpus."""
    named = question_rows(pages).select("path", "nr", tx.first("tag", r'\bdata-bron="([^"]*)"').alias("s")).where("s is not null")
    each = named.select("path", "nr", F.explode(F.filter(F.split(unescape_udf("s"), r"(?U)\s+"), lambda x: x != "")).alias("source"))
    return each.join(files.select(F.col("path").alias("source")), "source", "left_anti").select("path", "nr", "source")


def checked_sources(pages: DataFrame, files: DataFrame) -> DataFrame:
    """pages, if every source that a question names is there; else all that are missing are told together (gate.Invalid)."""
    label = F.concat("path", F.lit(" question "), F.col("nr").cast("string"), F.lit(": "), "source")
    gated(missing_sources(pages, files), {"sources that are not there": F.lit(True)}, label)
    return pages


def letter_skew(questions: DataFrame, least: int = 4) -> DataFrame:
    """Pages on which one letter is correct in more than half of the questions."""
    from vellum.operators.reconcile import majority

    at = questions.where("status = 'ok'").select("path", tx.letter(F.array_position(F.transform("choices", lambda c: c["correct"]), True) - 1).alias("letter"))
    return majority(at, ["path"], "letter", least)


def items(questions: DataFrame, package: str, titles: DataFrame | None = None) -> DataFrame:
    """item_id, path, nr, xml, hash of well-formed question items; all or nothing is for the caller, see question_rows."""
    ok = questions.where("status = 'ok'")
    item_id = F.concat(tx.identifier(F.lit(package)), F.lit("-"), F.lpad(F.col("nr").cast("string"), 2, "0"))
    rows = ok.withColumn("item_id", item_id).withColumn("stem_x", xhtml_udf("stem")["xhtml"])
    each = rows.select("path", "nr", "item_id", "stem_x", F.posexplode("choices").alias("pos", "c")).withColumn("cx", xhtml_udf("c.body")["xhtml"])
    choice = F.concat(F.lit('<simpleChoice identifier="'), tx.letter(F.col("pos")), F.lit('">'), "cx", F.lit("</simpleChoice>"))
    built = each.withColumn("choice", choice).groupBy("path", "nr", "item_id", "stem_x").agg(text_in_order("choice", ["pos"]).alias("choices_x"), F.max(F.when(F.col("c.correct"), tx.letter(F.col("pos")))).alias("right"))
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><assessmentItem xmlns="http://www.imsglobal.org/xsd/imsqti_v2p1" identifier="'), "item_id", F.lit('" title="'), "item_id",
        F.lit('" adaptive="false" timeDependent="false"><responseDeclaration identifier="RESPONSE" cardinality="single" baseType="identifier"><correctResponse><value>'), "right",
        F.lit('</value></correctResponse></responseDeclaration><itemBody><choiceInteraction responseIdentifier="RESPONSE" shuffle="true" maxChoices="1"><prompt>'), "stem_x", F.lit("</prompt>"), "choices_x", F.lit("</choiceInteraction></itemBody></assessmentItem>"),
    )
    return built.select("item_id", "path", "nr", xml.alias("xml")).withColumn("hash", item_hash(F.col("xml"), F.expr("cast(array() as array<binary>)"))).withColumn("external_id", F.concat("path", F.lit("#"), F.col("nr").cast("string"), F.lit("@"), "hash"))


def item_manifest(item_rows: DataFrame, package: str) -> DataFrame:
    """One row: the manifest of all items, in item order."""
    resource = F.concat(F.lit('<resource identifier="'), "item_id", F.lit('" type="imsqti_item_xmlv2p1" href="'), "item_id", F.lit('.xml"><file href="'), "item_id", F.lit('.xml"/></resource>'))
    listed = item_rows.withColumn("r", resource).agg(text_in_order("r", ["item_id"]).alias("rs"))
    return listed.select(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><manifest xmlns="http://www.imsglobal.org/xsd/imscp_v1p1" identifier="{package}"><organizations/><resources>'), "rs", F.lit("</resources></manifest>")).alias("xml"))


def _zipped(names: pd.Series, bodies: pd.Series) -> pd.Series:
    def one(ns, bs) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, b in zip(ns, bs, strict=True):
                z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), b)
        return out.getvalue()

    return pd.Series([one(n, b) for n, b in zip(names, bodies, strict=True)])


zip_udf = lazy_udf(_zipped, "binary")


def chapters_with_answers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, answers: the answers section of a chapter, only if each of its questions has an answer.

    rows(keys, place, nr, answer).
    """
    line = F.concat(F.lit("<li value='"), F.col("nr").cast("string"), F.lit("'>"), F.coalesce("answer", F.lit("")), F.lit("</li>"))
    per = rows.withColumn("line", line).groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("answer") != "", F.lit(False))).alias("complete"), text_in_order("line", ["place", "nr"]).alias("lines"))
    return per.where("complete").select(*keys, F.concat(F.lit("<ol>"), "lines", F.lit("</ol>")).alias("answers"))


def plain_text(c: Column | str) -> Column:
    """Text of a fragment: tags out, entities decoded, white space folded."""
    return tx.squeeze(unescape_udf(F.regexp_replace(tx.col(c), tx.TAG, " ")))
