"""The rule registry: a rule is a function of a corpus that returns rows of findings."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.corpus import Corpus

#: Severities of the findings contract.
ERROR, WARNING, ADVICE, DEVIATION = "fout", "waarschuwing", "advies", "afwijking"
FINDING = "pad string, regelnr int, boodschap string, ernst string"


@dataclass(frozen=True)
class Rule:
    id: str
    run: Callable[[Corpus], DataFrame]
    mode: str
    local_only: bool
    applies: Callable[[Corpus], bool | str]

    @property
    def explanation(self) -> str:
        return inspect.getdoc(self.run) or ""


RULES: dict[str, Rule] = {}


def rule(id: str, mode: str = "standard", local_only: bool = False, applies: Callable[[Corpus], bool | str | Needs] = lambda c: True):
    """Register a rule.  applies gives True, the reason why the rule does not apply, or the table that must have rows."""

    def register(fn: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        if id in RULES:
            raise ValueError(f"rule {id} is registered twice")
        RULES[id] = Rule(id, fn, mode, local_only, applies)
        return fn

    return register


def found(rows: DataFrame, message: Column | str, path: Column | str = "path", line: Column | str | None = None, severity: Column | str = ERROR) -> DataFrame:
    """Rows as findings; a text message is the message itself."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(
        (F.col(path) if isinstance(path, str) else path).alias("pad"),
        (F.lit(None) if line is None else F.col(line) if isinstance(line, str) else line).cast("int").alias("regelnr"),
        as_col(message).alias("boodschap"),
        as_col(severity).alias("ernst"),
    )


def single(corpus: Corpus, path: str, message: str, severity: str = ERROR) -> DataFrame:
    return corpus.spark.createDataFrame([(path, None, message, severity)], FINDING)


def nothing(corpus: Corpus) -> DataFrame:
    return corpus.spark.createDataFrame([], FINDING)


def union(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.unionByName(df)
    return first


@dataclass(frozen=True)
class Needs:
    """Applies if the table has a row; the runner asks for all such tables in one action."""

    table: DataFrame
    reason: str


def any_rows(df: DataFrame, reason: str) -> Needs:
    return Needs(df, reason)


def settled(answers: dict[str, bool | str | Needs]) -> dict[str, bool | str]:
    """True or the reason against it, for each rule: one job finds out which of the needed tables have rows."""
    asked = {k: a for k, a in answers.items() if isinstance(a, Needs)}
    parts = [a.table.select(F.lit(k).alias("k")).limit(1) for k, a in asked.items()]
    there = {r["k"] for r in union(*parts).collect()} if parts else set()
    return {k: (True if k in there else a.reason) if isinstance(a, Needs) else a for k, a in answers.items()}
