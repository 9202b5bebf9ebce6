"""Shared runs of words between texts of one group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.kernels import longest_run_udf


def word_runs(words: str, n: int):
    """All runs of n words, as an array of arrays."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(words, i + 1, n))).otherwise(F.expr("cast(array() as array<array<string>>)"))


def shared_runs(texts: DataFrame, group: str, order: list[str], words: str, least: int) -> DataFrame:
    """Pairs (a, b) of texts of a group, a before b, with a common run of `least` words or more: a, b, run.

    Candidates meet on equal runs of `least` words (an equi-join on their hash), so a
    group's texts are never paired with each other; then the longest run of each
    candidate pair is found.
    """
    keyed = texts.select(group, F.struct(*order).alias("at"), F.col(words).alias("w"))
    shingles = keyed.select(group, "at", F.explode(F.array_distinct(word_runs("w", least))).alias("s")).select(group, "at", F.xxhash64("s").alias("h"))
    x, y = shingles.alias("x"), shingles.alias("y")
    met = x.join(y, (F.col(f"x.{group}") == F.col(f"y.{group}")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.at") < F.col("y.at"))).select(F.col(f"x.{group}").alias(group), F.col("x.at").alias("a"), F.col("y.at").alias("b")).distinct()
    one, two = keyed.select(group, F.col("at").alias("a"), F.col("w").alias("wa")), keyed.select(group, F.col("at").alias("b"), F.col("w").alias("wb"))
    both = met.join(one, [group, "a"]).join(two, [group, "b"]).withColumn("r", longest_run_udf("wa", "wb")).where(F.col("r.length") >= least)
    return both.select(group, "a", "b", F.slice("wa", F.col("r.start") + 1, F.col("r.length")).alias("run"))
