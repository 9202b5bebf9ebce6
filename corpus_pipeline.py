"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes all that its predecessor kept and returns the columns of documents;
the last returns the shard assignment.  Toxic documents go; of each near-duplicate
component one document stays; contaminated documents go, and hit spans go from the
others; mixing repeats or leaves out documents for its targets; sharding assigns each
row a shard and a slot.  What a stage does with nulls, empty and very long texts, ties,
repeated rows, empty tables and further columns is stated where its operator is
defined; all stages carry further columns along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontam, mixing, sharding, simhash, toxicity
from vellum.llm.common import clean, fold, scratch_mark, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"), cut=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Automata, fingerprint components and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; of what the stages write, only each one's result is kept, until the next one's is there."""
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        clean(spark, mark, but_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
