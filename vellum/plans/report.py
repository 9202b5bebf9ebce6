"""Reports of findings: text, JSON version 1, hook mode."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.plans.registry import ADVICE, DEVIATION, ERROR, WARNING

SEVERITIES = (ERROR, WARNING, ADVICE, DEVIATION)
#: Names of the counters in the JSON report, in the order of SEVERITIES.
COUNTERS = ("fouten", "waarschuwingen", "adviezen", "afwijkingen")


def relabelled(findings: DataFrame, audit: bool) -> DataFrame:
    """In an audit a warning is advice."""
    return findings.withColumn("ernst", F.when(F.lit(audit) & (F.col("ernst") == WARNING), ADVICE).otherwise(F.col("ernst"))).withColumn("regelnr", F.nullif("regelnr", F.lit(0)))


def counts(findings: DataFrame) -> DataFrame:
    """One row with a count for each severity, zeros included."""
    return findings.agg(*(F.count_if(F.col("ernst") == s).alias(n) for s, n in zip(SEVERITIES, COUNTERS, strict=True)))


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, then in the order of rules, paths and lines."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("ernst"))
    return findings.orderBy(rank, "ord", "pad", F.col("regelnr").asc_nulls_first(), "boodschap")


def as_json(findings: DataFrame, repo: str, ci: bool = False, audit: bool = False) -> str:
    """The versioned report; only characters of ASCII."""
    rows = relabelled(findings, audit)
    c = counts(rows).first().asDict()
    listed = [{k: r[k] for k in ("regel", "ernst", "pad", "regelnr", "boodschap")} for r in ordered(rows).toLocalIterator()]
    return json.dumps({"versie": 1, "repo": repo, "ci": ci, "audit": audit, **c, "bevindingen": listed}, ensure_ascii=True)


def json_rows(findings: DataFrame) -> DataFrame:
    """Each finding as a JSON object, for sinks that stay distributed."""
    return findings.select(F.to_json(F.struct("regel", "ernst", "pad", "regelnr", "boodschap"), {"ignoreNullFields": "false"}).alias("finding"))


def as_text(findings: DataFrame, hook: bool = False) -> tuple[str, int]:
    """(report, exit code): 0 without errors, 1 with, 2 with errors in hook mode, which reports errors only."""
    rows = findings.where(F.col("ernst") == ERROR) if hook else findings
    c = counts(findings).first()
    lines = [f"{r['ernst']}: {r['pad']}{':' + str(r['regelnr']) if r['regelnr'] else ''}: [{r['regel']}] {r['boodschap']}" for r in ordered(rows).toLocalIterator()]
    if not hook:
        lines.append(", ".join(f"{c[n]} {n}" for n in COUNTERS[:2] + COUNTERS[3:]))
    return "\n".join(lines), (2 if hook else 1) if c["fouten"] else 0
