"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, conversations, decontam, katz, language, lines, mixing, oracle, phrases, quality, sharding, simhash, toxicity, warc
from vellum.llm.common import fold, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    texts = language.training_texts(docs, fold("doc_id", 4) != 2)
    return language.identify(docs, texts).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    got = toxicity.score(docs, toxicity.learn(docs, labels))
    return got.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_matches")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean(table(spark, sf_dir, "documents"), with_text=False)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = katz.score(docs, fold("doc_id", 10) != 0)
    return got.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.Vocabulary.from_json(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")), "copies")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language, op2_toxicity, op3_lines, op4_decontamination, op5_warc, op6_katz, op7_simhash, op8_quality, op9_mixing, op10_sharding, op11_bpe, op12_conversations, op13_phrases)}
ORACLE: dict[str, str] = {"op3_lines": oracle.LINES, "op4_decontamination": oracle.DECONTAMINATION, "op5_warc": oracle.WARC, "op6_katz": oracle.KATZ, "op12_conversations": oracle.CONVERSATIONS, "op13_phrases": oracle.PHRASES}
