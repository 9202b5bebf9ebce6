"""A corpus as DataFrames: files, pages with their subsets, and the menu."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.conf import DEFAULTS, merge
from vellum.functions import kernels
from vellum.functions import text as tx
from vellum.operators import menu as menus

ALWAYS_OUT = ["node_modules", ".git"]


@dataclass
class Corpus:
    """files(path, mtime, tracked) and texts(path, html) of all text files; conf as from conf.merge.

    tracked is null for every file when there is no version control; predicates on it
    are then skipped.  styles gives the times of style sheets outside the corpus.
    """

    files: DataFrame
    texts: DataFrame
    conf: dict = field(default_factory=lambda: merge(DEFAULTS, {}))
    has_git: bool = True
    local: bool = True
    styles: dict[str, float] = field(default_factory=dict)
    courses: bool = False  #: each top folder is a course with a menu and a style guide of its own

    def is_own(self, name: str, path: str = "path"):
        """Whether a path is the file of this name, in many courses that of any course."""
        if not self.courses:
            return F.col(path) == name
        return (F.substring_index(path, "/", -(name.count("/") + 1)) == name) & (F.size(F.split(path, "/")) == name.count("/") + 2)

    def course(self, path: str = "path"):
        """The course of a path: its top folder and a slash; nothing where there is one course only."""
        return F.concat(F.substring_index(path, "/", 1), F.lit("/")) if self.courses else F.lit("")

    def in_course(self, path: str = "path"):
        """A path as seen from its course."""
        return F.regexp_replace(path, "^[^/]*/", "") if self.courses else F.col(path)

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    @cached_property
    def pages(self) -> DataFrame:
        """HTML pages outside the excluded folders, with is_checked, is_site and is_audit."""
        c = self.conf
        html = self.texts.where(F.lower("path").endswith(".html") & ~tx.has_part("path", c["staging"] + ALWAYS_OUT))
        name = tx.basename("path")
        skip = c["check"]["skip_pages"]
        checked = ~(name.isin(skip) | F.col("path").isin(skip)) if skip else F.lit(True)
        site = ~name.isin(c["exempt_pages"]) & ~tx.has_part("path", c["non_site_dirs"], folders_only=True)
        tracked = self.files.where("tracked").select("path", F.lit(True).alias("t"))
        pages = html.withColumn("is_checked", checked).withColumn("is_site", site).join(tracked, "path", "left")
        in_git = F.coalesce("t", F.lit(False)) if self.has_git else F.lit(True)
        return pages.withColumn("is_audit", F.col("is_checked") & F.col("is_site") & in_git).drop("t").persist()

    @cached_property
    def checked(self) -> DataFrame:
        return self.pages.where("is_checked")

    @cached_property
    def lines(self) -> DataFrame:
        """path, nr, line and the page flags of all pages."""
        exploded = self.pages.select("path", "is_checked", "is_site", "is_audit", F.posexplode(F.split("html", "\n", -1)).alias("pos", "line"))
        return exploded.withColumn("nr", F.col("pos") + 1).drop("pos")

    @cached_property
    def questions(self) -> DataFrame:
        """One row for each question list: path, list_no, begin, declared, expected, items; comments left out."""
        pages = self.pages.where(F.col("is_checked") | self.in_syllabus("path")).withColumn("html", tx.without_comments("html"))
        lists = pages.where(F.col("html").rlike(r'<ol\b[^>]*class="[^"]*\bvragen\b')).select("path", F.explode(kernels.question_lists_udf("html")).alias("q"))
        return lists.select("path", "q.*").persist()

    def question_pages(self, with_test: bool = True) -> DataFrame:
        """path, html of pages with a question list; of staging folders only the tests' one, and only if asked."""
        c = self.conf
        test = F.col("path").startswith(c["paths"]["toets"] + "/") if with_test else F.lit(False)
        html = self.texts.where(F.lower("path").endswith(".html") & ~tx.has_part("path", ALWAYS_OUT) & (test | ~tx.has_part("path", c["staging"])))
        return html.where(F.size(kernels.question_lists_udf(tx.without_comments("html"))) > 0).select("path", "html")

    @cached_property
    def menu(self) -> DataFrame:
        """Flattened menu, see operators.menu.flatten."""
        return menus.flatten(self.texts.where(self.is_own(self.conf["menu"])).select("path", F.col("html").alias("doc"))).persist()

    def in_syllabus(self, path: str):
        return F.col(path).startswith(self.conf["paths"]["syllabus_src"] + "/")

    def text_of(self, path: str) -> str | None:
        """One small file's text, for what the driver must know."""
        row = self.texts.where(F.col("path") == path).select("html").first()
        return row["html"] if row else None

    def unpersist(self) -> None:
        for name in ("pages", "questions", "menu"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()


def from_dict(spark: SparkSession, contents: dict[str, str | None], conf: dict | None = None, untracked: tuple[str, ...] = (), mtimes: dict[str, float] | None = None, git: bool = True, local: bool = True, styles: dict[str, float] | None = None, t0: float = 1_750_000_000) -> Corpus:
    """A corpus of {path: text}; a None text is a file that is not text."""
    times = mtimes or {}
    files = spark.createDataFrame([(p, float(t0 + times.get(p, 0)), (p not in untracked) if git else None) for p in contents], "path string, mtime double, tracked boolean")
    texts = spark.createDataFrame([(p, t) for p, t in contents.items() if t is not None], "path string, html string")
    return Corpus(files, texts, merge(DEFAULTS, conf or {}), git, local, styles or {})


def from_directory(spark: SparkSession, root: str, conf: dict, tracked: list[str] | None, local: bool = True) -> Corpus:
    """A corpus below root, in any store that Spark reads; tracked: see sources.files.git_tracked."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub("^[a-z0-9+.-]+:/+", "/", root.rstrip("/") + "/")
    rel = F.substring_index(F.regexp_replace("path", "^[a-z0-9+.-]+:/+", "/"), base, -1)
    files = found.select(rel.alias("path"), F.col("modificationTime").cast("double").alias("mtime"))
    if tracked is None:
        files = files.withColumn("tracked", F.lit(None).cast("boolean"))
    else:
        listed = spark.createDataFrame([(t,) for t in tracked], "path string").withColumn("tracked", F.lit(True))
        files = files.join(listed, "path", "left").withColumn("tracked", F.coalesce("tracked", F.lit(False)))
    texts = found.where(F.lower("path").rlike(r"\.(html?|css|js|json|md)$")).select(rel.alias("path"), F.decode("content", "UTF-8").alias("html"))
    return Corpus(files.persist(), texts, merge(DEFAULTS, conf), tracked is not None, local)
