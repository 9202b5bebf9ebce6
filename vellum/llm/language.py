"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises exactly the
substrings of that text.  A document (runs of letters, lower case, one space between
them and at both ends) is parsed greedily into longest matches, across its words; its
phrases, times log2 of the training length, are its code length in bits, and over its
letters and spaces its cross-parsing entropy.  The language with the shortest code
wins; ties go to the lower code point.  The score is the winner's share of 2 ** -bits
of all languages.

Training: copies of a text count once.  Of each of the `most_languages` languages with
most texts (ties: the lower code point), texts are taken in a seeded-hash order, those
of over `long_text` characters after the others, until `chars_per_language` is reached,
at most `rows_per_language` of them.  These documented bounds of the sample keep the
automata small whatever the corpus.  Scoring reads every whole text once, without a
shuffle; a text of any length is parsed in one pass.

A letter is what str.isalpha accepts.  A null text, or one without letters, is `und`
with score 0, as is every text when nothing was learned.  Rows that repeat get equal
results.  An empty table gives an empty result.  Only the id, text and language
columns are read, whatever others are called.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import checkpointed, small_batches

WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """Runs of letters, lower case."""
    found = WORDS.findall(text.lower()) if text else []
    if "".join(found).isalpha() or not found:
        return found
    # numerals such as a half or a Roman eight are word characters, but no letters
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


class Substrings:
    """Suffix automaton over characters; only what parsing needs is kept: each state as a map from character to state."""

    def __init__(self, text: str):
        nxt, link, length = [{}], [-1], [0]
        last = 0
        for c in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    new = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = new
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = new
                        p = link[p]
            last = cur
        for state in nxt:
            for c, k in state.items():
                state[c] = nxt[k]
        self.root = nxt[0]

    def phrases(self, text: str) -> int:
        """Greedy longest matches that cover the text; an unseen character is a phrase."""
        here = root = self.root
        n = 0
        for c in text:
            if c in here:
                here = here[c]
            else:
                if here is not root:
                    n += 1
                if c in root:
                    here = root[c]
                else:
                    n += 1
                    here = root
        return n + (here is not root)


class Parser:
    """Automata of all languages."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.automata = [Substrings(texts[k]) for k in self.names]
        self.bits = np.array([math.log2(len(texts[k]) + 2) for k in self.names])
        gc.freeze()  # the states stay as long as the worker; collections need not visit them

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = letters(text)
        if not words or not self.names:
            return "und", 0.0
        line = f" {' '.join(words)} "
        bits = np.array([a.phrases(line) for a in self.automata]) * self.bits
        best = int(bits.argmin())
        return self.names[best], float(1 / np.exp2(bits[best] - bits).sum())


_PARSERS: dict[str, Parser] = {}


def training_texts(docs: DataFrame, train: Column, rows_per_language: int = 200, chars_per_language: int = 60_000, long_text: int = 4_000, most_languages: int = 100, seed: int = 42) -> dict[str, str]:
    """Bounded text of each language, from columns doc_id, text and lang."""
    docs = docs.select("doc_id", "text", "lang")
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one row for each different text: a group of copies, however large, is summed up before it is shuffled
    once = known.groupBy("lang", F.xxhash64("text", F.lit(seed)).alias("h"), F.length("text").alias("n")).agg(F.min("doc_id").alias("doc_id"))
    once = checkpointed(once)
    langs = once.groupBy("lang").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "lang").limit(most_languages).select("lang")
    ranked = once.join(F.broadcast(langs), "lang").withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n") > long_text, "h", "doc_id", "n"))).where(F.col("rn") <= rows_per_language)
    ranked = ranked.withColumn("before", F.sum("n").over(Window.partitionBy("lang").orderBy("rn")) - F.col("n")).where(F.col("before") < chars_per_language)
    picked = F.broadcast(ranked.select(F.col("doc_id").alias("p_id"), F.col("lang").alias("p_lang"), F.col("h").alias("p_h"), "rn"))  # at most rows_per_language rows for each language
    same = docs["doc_id"].eqNullSafe(picked["p_id"]) & (docs["lang"] == picked["p_lang"]) & (F.xxhash64(docs["text"], F.lit(seed)) == picked["p_h"])
    found = docs.where(F.col("text").isNotNull()).join(picked, same).select("lang", "rn", "text").dropDuplicates().collect()
    texts: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["rn"], r["text"])):
        texts.setdefault(r["lang"], []).extend(letters(r["text"]))
    return {k: f" {' '.join(v)} " for k, v in texts.items() if v}


def identify(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for each row of docs."""
    small_batches(docs.sparkSession)
    key = hashlib.sha256(repr(sorted(texts.items())).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = Parser(shared.value)
        parse = _PARSERS[key]
        for batch in batches:
            got = [parse(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
