"""The pipeline's stages one by one, on planted cases."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from vellum.llm.common import table

VOCAB = ["".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(3 + i % 5)) for i in range(700)]


def prose(seed, n=150):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCAB) for _ in range(n)) + "."


def write_inputs(spark, folder, edges=False, empty=False):
    """documents, labels and benchmark with toxic documents, copies and leaks among clean ones (100 to 139)."""
    bad = "idiot moron scum worthless pathetic"
    docs = [(i, f"you {bad} {prose(i, 20)} {bad}", "en", "a", 1) for i in (1, 2, 3)]
    docs += [(i, prose(i), "en", "abc"[i % 3], 1) for i in range(100, 140)]
    docs += [(200, prose(100), "en", "a", 1), (201, prose(100).replace(".", " extra."), "en", "b", 1)]
    leak = prose(999, 40)
    docs += [(300, prose(300, 60) + " " + leak, "en", "a", 1), (301, leak.upper(), "en", "b", 1)]
    if edges:
        docs += [(None, None, None, None, None), (2, None, None, None, None), (401, "", "en", None, 0), (402, " ".join(VOCAB) * 200, "en", None, 0), (100, prose(100), "en", "b", 1)]
    docs = [] if empty else docs
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [] if empty else [(i, 1, 0) for i in range(100, 140)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([] if empty else [(0, leak), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, tmp_path):
    d = write_inputs(spark, tmp_path)
    docs = table(spark, d, "documents")
    before = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "decontamination", "mixing", "sharding"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, d)
        if name != "sharding":
            assert out.columns == docs.columns
        kept[name] = [r["doc_id"] for r in out.select("doc_id").collect()]
        before = out
    clean = set(range(100, 140))
    toxic, copies, leaks = {1, 2, 3}, {100, 200, 201}, {300, 301}
    assert not toxic & set(kept["toxicity"]) and clean <= set(kept["toxicity"])
    assert copies & set(kept["near duplicates"]) == {100} and clean <= set(kept["near duplicates"])
    assert not leaks & set(kept["decontamination"]) and clean <= set(kept["decontamination"])
    assert sorted(kept["sharding"]) == sorted(kept["mixing"])
    assert max(kept["mixing"].count(i) for i in set(kept["mixing"])) <= 2


def test_run_handles_edges(spark, tmp_path):
    d = write_inputs(spark, tmp_path, edges=True)
    got = corpus_pipeline.run(spark, d).collect()
    assert got and {"doc_id", "shard", "slot"} <= set(got[0].asDict())


def test_run_on_empty_tables(spark, tmp_path):
    d = write_inputs(spark, tmp_path, empty=True)
    assert corpus_pipeline.run(spark, d).collect() == []



def test_stages_keep_extra_columns(spark, tmp_path):
    """Columns called as the operators' own ones pass every stage but the last."""
    d = write_inputs(spark, tmp_path, edges=True)
    names = ["fp", "h", "rep", "id", "c0", "times", "m_copy", "size", "toxic", "own_fp", "n_hit", "spans", "key"]
    docs = table(spark, d, "documents")
    for n in names:
        docs = docs.withColumn(n, F.lit("kept"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        got = out.collect()
        assert out.columns == docs.columns and got and all(r[n] == "kept" for r in got for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == docs.count()


def test_leaks_below_the_limit_are_cut(spark, tmp_path):
    d = write_inputs(spark, tmp_path)
    leak = prose(999, 40)
    long = prose(500, 900) + " " + leak + " " + prose(501, 900)
    docs = spark.createDataFrame([(1, long, "en", "a", 1), (2, prose(3), "en", "a", 1)], table(spark, d, "documents").schema)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_benchmark(spark, docs, d).collect()}
    assert leak.rstrip(".") not in got[1] and got[1].startswith(prose(500, 900)) and got[2] == prose(3)
