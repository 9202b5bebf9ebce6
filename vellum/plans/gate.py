"""A validation gate: rows are judged in the pass that writes them, and all errors are told together.

`observe()` counts the failures of each check while the result is written, so judging
costs no job of its own.  The result is written to a place of its own first; only if no
check failed is it what the caller gets, else the written rows say which ones failed and
the error names all checks, with a few cases of each, before anything is used.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vellum.sources.shared import new_path


class Invalid(ValueError):
    """All that is wrong, check by check."""

    def __init__(self, failures: Mapping[str, tuple[int, list[str]]]):
        self.failures = {k: n for k, (n, _) in failures.items()}
        lines = [f"{name}: {n} ({', '.join(cases)}{', ...' if n > len(cases) else ''})" if cases else f"{name}: {n}" for name, (n, cases) in failures.items()]
        super().__init__("\n".join(lines))


def gated(rows: DataFrame, checks: Mapping[str, Column], label: str | Column | None = None, order: Column | None = None, shown: int = 5, write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """rows, written once, if no row fails a check; else Invalid with all checks that fail.

    checks: name to a condition of failing rows, null counts as none.  label names a
    row in the error, order sorts what is named.  The judged rows are read once: metrics
    are gathered while they are written.  Only where there are failures is the written
    table read again, and then for `shown` rows of each check.
    """
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "gate")
    named = rows.withColumns({f"_fails_{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(checks.values())})
    watch = Observation()
    observed = named.observe(watch, F.count("*").alias("rows"), *(F.count_if(F.col(f"_fails_{i}")).alias(f"f{i}") for i in range(len(checks))))
    (write or (lambda df, p: df.write.parquet(p)))(observed, path)
    counts = watch.get
    done = spark.read.schema(named.schema).parquet(path)
    failed = [(i, name) for i, name in enumerate(checks) if counts[f"f{i}"]]
    if failed:
        name = F.col(label) if isinstance(label, str) else label
        key = [order if order is not None else name]
        cases = lambda i: [] if name is None else [str(r["x"]) for r in done.where(f"_fails_{i}").orderBy(*key).limit(shown).select(name.alias("x")).collect()]
        raise Invalid({n: (counts[f"f{i}"], cases(i)) for i, n in failed})
    return done.drop(*(f"_fails_{i}" for i in range(len(checks))))


def unique(key: Column | str) -> Column:
    """Fails on all rows of a key that another row has too; null keys never fail."""
    from pyspark.sql import Window

    k = F.col(key) if isinstance(key, str) else key
    return k.isNotNull() & (F.count("*").over(Window.partitionBy(k)) > 1)
