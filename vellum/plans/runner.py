"""Run the rules on a corpus: one flat findings table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.corpus import Corpus
from vellum.plans import rules  # noqa: F401  registers all rules
from vellum.plans.registry import RULES, Rule, settled, single

FINDINGS = ["regel", "ernst", "pad", "regelnr", "boodschap"]


def statuses(c: Corpus, rules: list[Rule]) -> dict[str, tuple[str, str]]:
    """('active', ''), ('off', reason) or ('n.a.', reason) of each rule; at most one job."""
    out, open_ = {}, {}
    for r in rules:
        if reason := c.conf["check"]["disable"].get(r.id):
            out[r.id] = ("off", str(reason))
        elif r.local_only and not c.local:
            out[r.id] = ("n.a.", "only on a working copy")
        else:
            open_[r.id] = r.applies(c)
    return out | {k: ("active", "") if a is True else ("n.a.", str(a)) for k, a in settled(open_).items()}


def rules_status(c: Corpus, modes: tuple[str, ...] = ("standard",)) -> DataFrame:
    """regel, mode, stand, reden of each rule of these modes."""
    rules = [r for r in RULES.values() if r.mode in modes]
    found = statuses(c, rules)
    return c.spark.createDataFrame([(r.id, r.mode, *found[r.id]) for r in rules], "regel string, mode string, stand string, reden string")


def disable_errors(c: Corpus) -> list[DataFrame]:
    """Disabled rules must exist and give their reason."""
    bad = [(k, "unknown rule in check.disable") for k in c.conf["check"]["disable"] if k not in RULES]
    bad += [(k, "a disabled rule needs a reason") for k, v in c.conf["check"]["disable"].items() if k in RULES and not str(v).strip()]
    return [single(c, "config", f"{text}: {k}").withColumn("regel", F.lit(None).cast("string")).withColumn("ord", F.lit(-1)) for k, text in bad]


def findings(c: Corpus, modes: tuple[str, ...] = ("standard",), only: list[str] | None = None) -> DataFrame:
    """Findings of all active rules of these modes, with the rules' order in `ord`.

    One job tells which rules apply; what is left are independent plans over the
    corpus's cached tables, joined in one union.  A few rules look at small tables of
    their own first (the module names of a menu, a manifest, the names of images).
    """
    if unknown := set(only or ()) - set(RULES):
        raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")
    parts = disable_errors(c)
    chosen = [(k, r) for k, r in enumerate(RULES.values()) if r.mode in modes and (only is None or r.id in only)]
    stand = statuses(c, [r for _, r in chosen])
    for k, r in chosen:
        if stand[r.id][0] == "active":
            parts.append(r.run(c).withColumn("regel", F.lit(r.id)).withColumn("ord", F.lit(k)))
    if not parts:
        return c.spark.createDataFrame([], "regel string, ernst string, pad string, regelnr int, boodschap string, ord int")
    return reduce(DataFrame.unionByName, parts).select(*FINDINGS, "ord")
