"""Toxicity from a lexicon matched by Levenshtein automata.

The lexicon is learned from labelled rows: words that toxic documents hold far more
often than others.  They form one trie.  A word of a document is looked up by
intersecting its Levenshtein automaton with the trie, after folding look-alike digits and
signs: a term of five letters or more accepts one edit, at a lower weight, a shorter one
none.  Each match is weighed by its context window: quotation marks or a reporting verb
around it lower it, a second person raises it.  The weights of a document of n words
sum up to w; s = w / (1 + n / 100), since a few chance matches in a long text mean
little.  Its score is 1 - 0.3 ** (s / cut), which is 0.7 at the cut that separates the
labelled sample best.

Training reads at most `sample` labelled rows (seeded-hash order), kept as a table;
scoring reads every whole text once, without a shuffle.  A term is in `min_docs` of the
sampled rows at least, so what is broadcast is bounded by the sample's words.  Words
that begin or end like no term are passed by without a walk through the trie; one edit
leaves one half of a term as it is, so none is lost.

Null and empty texts score 0.  A text of any length is scored whole, one at a time.
Ties in the choice of terms go to the lower term; at the cut a text counts as toxic.
Rows that repeat score alike.  Without labels the lexicon is `seeds` and the cut 1.
An empty table gives an empty result.  Only the id and the text are read, whatever
other columns are called; `keep_clean` carries them along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import checkpointed, small_batches, utf8, written

TOKEN = re.compile(r"[^\W_]+(?:[@$*][^\W_]+)*")
#: Look-alike signs (fixed values).
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": None})
QUOTES = '"“”„«»'
#: Verbs and nouns that report what others say, and second persons (fixed values).
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes term word phrase reported sagte nannte schrieb dit appelle dijo llama".split())
ADDRESS = frozenset("you your yours yourself u ur du dich dir dein tu toi te ton vous tú ti eres".split())
SEEDS = ("idiot", "moron", "stupid", "worthless", "pathetic", "scum")


class Levenshtein:
    """Automaton of the words within k edits of a word; a state lists (position, edits) pairs."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> tuple:
        return tuple((i, i) for i in range(min(self.k, len(self.word)) + 1))

    def step(self, state: tuple, c: str) -> tuple:
        best: dict[int, int] = {}
        word, k = self.word, self.k
        for i, e in state:
            for j, f in ((i, e + 1), *(((i + 1, e + (word[i] != c)),) if i < len(word) else ())):  # an inserted letter; a kept or changed one
                if f <= k and f < best.get(j, k + 1):
                    best[j] = f
        for i in sorted(best):  # a deleted letter
            j, f = i + 1, best[i] + 1
            while j <= len(word) and f <= k and f < best.get(j, k + 1):
                best[j] = f
                j, f = j + 1, f + 1
        return tuple(sorted(best.items()))

    def distance(self, state: tuple) -> int | None:
        """Edits if the state accepts."""
        return min((e + len(self.word) - i for i, e in state if e + len(self.word) - i <= self.k), default=None)


class Lexicon:
    """Terms in a trie; finds a word's weight.  edits: how many a long term accepts."""

    def __init__(self, terms: dict[str, float], fuzzy: float = 0.7, long: int = 5, memo: int = 150_000, edits: int = 1):
        self.terms, self.fuzzy, self.long, self.memo, self.edits = terms, fuzzy, long, memo, edits
        self.trie: dict = {}
        #: What a word that matches begins or ends with, by length.
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        for t in terms:
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node["term"] = t  # characters are keys of length one, so this is none
            half = len(t) // 2 if len(t) >= long else len(t)
            self.heads.setdefault(half, set()).add(t[:half])
            if half < len(t):
                self.tails.setdefault(len(t) - half, set()).add(t[half:])
        self.known: dict[str, float] = {}

    def may_match(self, word: str) -> bool:
        return any(word[:n] in s for n, s in self.heads.items()) or any(word[-n:] in s for n, s in self.tails.items())

    def matches(self, word: str) -> list[tuple[int, str]]:
        """(edits, term) of all terms that the word matches."""
        auto, found = Levenshtein(word, self.edits), []
        todo = [(self.trie, auto.start())]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "term":
                    d = auto.distance(state)
                    if d is not None and d <= (self.edits if len(child) >= self.long else 0):
                        found.append((d, child))
                elif after := auto.step(state, c):
                    todo.append((child, after))
        return found

    def _weigh(self, word: str) -> float:
        if any(not c.isalpha() for c in word) and any(c.isalpha() for c in word):
            word = word.translate(LEET)
        if not self.may_match(word):
            return 0.0
        return max((self.terms[t] * (self.fuzzy if d else 1.0) for d, t in self.matches(word)), default=0.0)

    def weights(self, words: list[str]) -> list[float]:
        known, out = self.known, []
        for w in words:
            x = known.get(w)
            if x is None:
                if len(known) >= self.memo:
                    known.clear()
                x = known[w] = self._weigh(w)
            out.append(x)
        return out

    def score(self, text: str | None, window: int = 6, half: float = 100.0) -> tuple[float, int]:
        """Sum of context weights over 1 + words / half, and the number of matches."""
        if not text:
            return 0.0, 0
        low = text.lower()
        words = TOKEN.findall(low)
        weights = self.weights(words)
        if not any(weights):
            return 0.0, 0
        spots = [m.span() for m in TOKEN.finditer(low)]
        total, n = 0.0, 0
        for i, w in enumerate(weights):
            if not w:
                continue
            n += 1
            a, b = max(0, i - window), min(len(words), i + window + 1)
            before, after = low[spots[a][0] : spots[i][0]], low[spots[i][1] : spots[b - 1][1] + 1]
            if sum(before.count(q) for q in QUOTES) % 2 and any(q in after for q in QUOTES):
                w *= 0.3
            if any(x in REPORTING for x in words[a:i]):
                w *= 0.5
            if any(x in ADDRESS for x in words[a:b]):
                w *= 1.25
            total += w
        if n == 1:  # one match alone is weak evidence
            total *= 0.5
        return total / (1 + len(words) / half), n


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    cut: float = 1.0
    edits: int = 1


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic documents, other documents) of a partition, in parts."""
    found: dict[str, list[int]] = {}

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], names=["word", "bad", "good"])
        found.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in set(TOKEN.findall((text or "").lower())):
                found.setdefault(w, [0, 0])[0 if toxic else 1] += 1
        if len(found) > 60_000:
            yield flush()
    yield flush()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest hash of a text's three-word shingles; near copies mostly share it."""
    for batch in batches:
        keys = []
        for text in batch.column(0).to_pylist():
            w = utf8(text).lower().split()
            keys.append(min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 3])) >> 1 for i in range(max(1, len(w) - 2))), default=0))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0), batch.column(1)], names=["sketch", "text", "toxic"])


def _lexicon(model: Model) -> Lexicon:
    """One lexicon for each Python worker."""
    key = hashlib.sha256(repr((sorted(model.terms.items()), model.edits)).encode()).hexdigest()
    if key not in _LEXICA:
        _LEXICA.clear()
        _LEXICA[key] = Lexicon(model.terms, edits=model.edits)
    return _LEXICA[key]


def _raw(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """doc_id, s, n_matches."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(shared.value)
        for batch in batches:
            got = [lexicon.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], names=["doc_id", "s", "n_matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, s double, n_matches long")


_LEXICA: dict[str, Lexicon] = {}


def best_cut(s: np.ndarray, toxic: np.ndarray) -> float:
    """The s whose excess separates best by F1; halfway to the next lower value; 1 if there is nothing to learn."""
    if not toxic.any() or toxic.all():
        return 1.0
    values = np.unique(s[s > 0])
    if not len(values):
        return 1.0
    order = np.sort(s[toxic == 1])
    rest = np.sort(s[toxic == 0])
    tp = len(order) - np.searchsorted(order, values)
    fp = len(rest) - np.searchsorted(rest, values)
    f1 = 2 * tp / (tp + fp + len(order))
    k = int(f1.argmax())
    return float((values[k] + (values[k - 1] if k else 0.0)) / 2)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 6000, min_docs: int = 4, odds: float = 20.0, seeds: tuple[str, ...] = SEEDS, seed: int = 42, edits: int = 1) -> Model:
    """A model from labels(doc_id, toxic) and docs(doc_id, text); the caller leaves out what may not be learned from.

    odds: how much likelier a toxic document must be to hold a term than another is.
    """
    small_batches(docs.sparkSession)
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)  # a bounded top-k
    rows = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "toxicity-sample")
    n = {int(r["toxic"] > 0): r["n"] for r in rows.dropDuplicates(["doc_id"]).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad:
        return Model(dict.fromkeys(seeds, 1.0), edits=edits)
    # copies and near copies of one text count once, else each of their words looks telling
    once = rows.select("text", "toxic").mapInArrow(_sketch, "sketch long, text string, toxic int").groupBy("sketch").agg(F.min_by("text", F.struct("text")).alias("text"), F.max("toxic").alias("toxic"))
    counts = checkpointed(once.select("text", "toxic").mapInArrow(_words, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    telling = (F.col("bad") >= min_docs) & ((F.col("bad") + 0.5) * (good + 1) >= odds * (F.col("good") + 0.5) * (bad + 1))
    words = [r["word"] for r in counts.where(telling & (F.length("word") >= 3)).orderBy("word").collect()]  # words of the sample
    model = Model(dict.fromkeys([*words, *seeds], 1.0), edits=edits)
    got = _raw(rows, model, "toxic", "text").select("s", F.col("doc_id").alias("toxic")).toPandas()  # a row for each of the sample
    return Model(model.terms, best_cut(got["s"].to_numpy(float), got["toxic"].to_numpy(int)), edits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_matches for each row of docs."""
    raw = _raw(docs, model, id_col, text_col)
    curve = 1 - F.pow(F.lit(0.3), F.col("s") / model.cut)
    # at the cut the curve is 0.7 but for rounding
    raw = raw.withColumn("score", F.when(F.col("s") >= model.cut, F.greatest(curve, F.lit(0.7))).otherwise(F.least(curve, F.lit(0.6999999))))
    return raw.select("doc_id", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_matches", "s")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is below the cut."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(t)[0] < shared.value.cut for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
