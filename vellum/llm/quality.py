"""Quality classifier from a weak-label model.

Heuristic labellers vote good, bad or nothing on a text.  Expectation-maximisation
over the counts of vote patterns estimates each labeller's accuracies and the share
of good texts, without any labelled row; a pattern's posterior is the label of its
texts.  Posterior labels of a bounded sample train a linear scorer on hashed
features, which then scores every whole text.

Scale.  The texts are read once, whole: each leaves its votes, and its features as a
short packed string (about a fifth of the text), in a table below the shared folder.
Counting vote patterns (at most 3 ** labellers reach the driver), fitting the scorer
on at most `sample` rows, and scoring read that table.  No text is shuffled.

Null and empty texts get the votes their lack of words earns, and a score as any
other.  Rows that repeat get equal scores.  A text of any length is held as its words;
its word pairs are counted over the whole of it.  A score of exactly a half is kept.
An empty table gives an empty result.  Only the id and the text are read, whatever
other columns are called.  Results do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import small_batches, written

GOOD, BAD, NONE = 1, 0, 2
DIM = 4096


def _vote(good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else NONE


@dataclass
class Facts:
    """What the labellers look at."""

    words: int
    symbol_share: float  #: words that hold one of #*$%&|<>
    bar_share: float  #: words that are separators
    shout_share: float  #: words in capitals
    mark_share: float  #: words that end in two marks or more
    word_chars: float  #: mean length
    repeat_share: float  #: word pairs that are not the first of their kind
    dup_lines: float  #: lines equal to an earlier one
    stops: float  #: sentence ends for each word


#: Labellers, by name; each votes on its own view of a text.
LABELLERS = {
    "symbols": lambda f: _vote(f.symbol_share < 0.02, f.symbol_share > 0.1),
    "bars": lambda f: _vote(f.bar_share == 0, f.bar_share > 0.05),
    "shouting": lambda f: _vote(f.shout_share < 0.05, f.shout_share > 0.3),
    "marks": lambda f: _vote(f.mark_share < 0.01, f.mark_share > 0.1),
    "length": lambda f: _vote(f.words >= 60, f.words < 8),
    "word_size": lambda f: _vote(3 <= f.word_chars <= 9, f.word_chars < 2 or f.word_chars > 15),
    "repetition": lambda f: _vote(f.repeat_share < 0.3, f.repeat_share > 0.5),
    "lines": lambda f: _vote(f.dup_lines == 0, f.dup_lines > 0.4),
    "sentences": lambda f: _vote(0.02 < f.stops < 0.5, f.words >= 30 and f.stops < 0.003),
}


class Shapes(dict):
    """Memo from word to a row of flags and hashed features."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit
        self.flags = np.zeros((limit, 6), dtype=np.float32)
        self.hashed = np.zeros((limit, 2), dtype=np.int32)

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        row = self._row(word)
        self.flags[i], self.hashed[i] = row[:6], row[6:]
        return i

    def ids(self, words: list[str]) -> np.ndarray:
        """Row numbers; they hold until the next call."""
        if len(self) + len(words) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    @staticmethod
    def _row(w: str) -> tuple:
        shape = re.sub(r"(.)\1+", r"\1+", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in w))
        symbol, bar = any(c in "#*$%&|<>" for c in w), w in BARS
        marks = len(w) > 1 and not w[-1].isalnum() and w[-1] == w[-2]
        core = w.strip(MARKS)
        return (symbol, bar, len(w) > 1 and w.isupper(), marks, len(w), w[-1] in ".!?", _slot("s" + shape), DIM // 2 + _slot("p" + core[:3].lower()))


MARKS, BARS = ".,;:!?()\"'", frozenset("|>*/-»")


@lru_cache(100_000)
def _slot(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % (DIM // 2)


def facts(text: str | None, shapes: Shapes, step: int = 100_000) -> tuple[Facts, np.ndarray]:
    """The facts, and counts of hashed features."""
    words = (text or "").split()
    if not words:
        return Facts(0, 0, 0, 0, 0, 0, 0, 0, 0), np.zeros(DIM)
    n = len(words)
    sums, counts = np.zeros(6), np.zeros(DIM)
    for k in range(0, n, step):
        ids = shapes.ids(words[k : k + step])
        sums += shapes.flags[ids].sum(0, dtype=float)
        counts += np.bincount(shapes.hashed[ids].ravel(), minlength=DIM)
    if n > step:  # the memo may have been cleared in between, so pairs get numbers of the text's own
        own = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, base = np.fromiter(map(own.__getitem__, words), dtype=np.int64, count=n), len(own)
    else:
        base = shapes.limit
    kinds = len(np.unique(ids[:-1] * base + ids[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    return Facts(n, *(sums[:4] / n), sums[4] / n, 1 - kinds / (n - 1) if n > 1 else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0, sums[5] / n), counts


def votes(f: Facts) -> int:
    """All votes as one number, base three."""
    code = 0
    for vote in LABELLERS.values():
        code = 3 * code + vote(f)
    return code


def own_features(f: Facts) -> np.ndarray:
    """The facts on a common scale; the last is the bias."""
    return np.array([f.symbol_share, f.bar_share, f.shout_share, f.mark_share, min(f.word_chars, 20) / 20, f.repeat_share, f.dup_lines, min(f.stops, 1.0), min(np.log1p(f.words), 10) / 10, 1.0])


def features(f: Facts, counts: np.ndarray) -> np.ndarray:
    """Hashed shares, and the facts on a common scale."""
    return np.r_[np.sqrt(counts / max(1, f.words)), own_features(f)]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern (rows of 0 bad, 1 good, 2 none), and accuracies[class, labeller].

    Labellers are independent given the class; a vote's chance is its accuracy, an
    abstention says nothing.  Starts from the majority, smoothed.
    """
    good, bad = patterns == GOOD, patterns == BAD
    # a bad vote is rare and specific, so it starts with more weight than a good one
    post = 1 / (1 + np.exp(-(good.sum(1) * 0.5 - bad.sum(1) * 2.5)))
    acc = np.full((2, patterns.shape[1]), 0.7)
    for _ in range(rounds):
        w = counts * post
        v = counts - w
        acc = np.array([(v @ bad + 2) / (v @ (good | bad) + 3), (w @ good + 2) / (w @ (good | bad) + 3)])
        prior = (w.sum() + 1) / (counts.sum() + 2)
        a = np.log(prior) + good @ np.log(acc[1]) + bad @ np.log(1 - acc[1])
        b = np.log(1 - prior) + bad @ np.log(acc[0]) + good @ np.log(1 - acc[0])
        new = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            post = new
            break
        post = new
    return post, acc


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by full-batch Adagrad; the classes weigh equally."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    w = np.zeros(x.shape[1], dtype=np.float32)
    grad2 = np.full(x.shape[1], 1e-8, dtype=np.float32)
    total = [max(1e-9, (1 - y).sum()), max(1e-9, y.sum())]
    weight = (y / total[1] + (1 - y) / total[0]).astype(np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (weight * (p - y)) + decay * w
        grad2 += g * g
        w -= rate * g / np.sqrt(grad2)
    return w.astype(float)


_MEMO: dict[str, Shapes] = {}
FACTS = len(Facts.__dataclass_fields__)


def packed(f: Facts, counts: np.ndarray) -> bytes:
    """A text's facts and its counts above zero."""
    at = np.flatnonzero(counts)
    return np.array(astuple(f)).tobytes() + at.astype("<u2").tobytes() + counts[at].astype("<u4").tobytes()


def unpacked(data: bytes) -> tuple[Facts, np.ndarray, np.ndarray]:
    """Facts, and the places and values of the counts."""
    head = 8 * FACTS
    n = (len(data) - head) // 6
    return Facts(*np.frombuffer(data, float, FACTS)), np.frombuffer(data, "<u2", n, head), np.frombuffer(data, "<u4", n, head + 2 * n)


def examined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, code (the votes as one number) and data (facts and counts) of every text, as a table."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _MEMO.setdefault("shapes", Shapes())
        for batch in batches:
            got = [facts(t, shapes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([votes(f) for f, _ in got], pa.int64()), pa.array([packed(f, c) for f, c in got], pa.binary())], names=["doc_id", "code", "data"])

    kind = docs.schema[id_col].dataType.simpleString()
    return written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, code long, data binary"), "quality")


@dataclass(frozen=True)
class Model:
    posterior: dict[int, float]  #: of each vote pattern
    accuracies: dict[str, tuple[float, float]]  #: of each labeller on bad and on good texts
    weights: np.ndarray


def learn(seen: DataFrame, sample: int = 3000, seed: int = 42) -> Model:
    """Fit on a table of `examined` texts; sample bounds the rows that train the linear scorer."""
    patterns_seen = seen.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    codes = [r["code"] for r in patterns_seen]
    k = len(LABELLERS)
    patterns = np.array([[c // 3 ** (k - 1 - i) % 3 for i in range(k)] for c in codes], dtype=int).reshape(-1, k)
    post, acc = expectation_maximisation(patterns, np.array([r["n"] for r in patterns_seen], dtype=float))
    posterior = dict(zip(codes, post.tolist(), strict=True))
    # texts that count alike are one row, so that copies do not fill the sample
    hashed = seen.select("code", "data", F.xxhash64("data", F.lit(seed)).alias("h"))
    picked = hashed.select(F.col("h").alias("p")).distinct().orderBy("p").limit(sample)
    rows = hashed.join(F.broadcast(picked), F.col("h") == F.col("p")).groupBy("h").agg(F.min(F.struct("data", "code")).alias("r")).orderBy("h").select("r.*").collect()
    x = np.zeros((len(rows), DIM + 10), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i] = features(*_counted(bytes(r["data"])))
    y = np.array([posterior[r["code"]] for r in rows])
    weights = train(x, y) if len(x) else np.zeros(DIM + 10)
    return Model(posterior, {name: (float(acc[0, i]), float(acc[1, i])) for i, name in enumerate(LABELLERS)}, np.round(weights, 9))


def _counted(data: bytes) -> tuple[Facts, np.ndarray]:
    f, at, n = unpacked(data)
    counts = np.zeros(DIM)
    counts[at] = n
    return f, counts


def score(seen: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, posterior (of the votes), score (of the scorer, 0 to 1) and kept (score of a half or more) of `examined` texts."""
    shared = seen.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = []
            for code, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                f, at, n = unpacked(data)
                z = float(np.sqrt(n / max(1, f.words)) @ m.weights[at]) + float(own_features(f) @ m.weights[DIM:])
                got.append((int(f.words), m.posterior.get(code, 0.5), 1 / (1 + np.exp(-np.clip(z, -50, 50)))))
            cols = list(zip(*got, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array([s >= 0.5 for s in cols[2]], pa.bool_())], names=["doc_id", "n_words", "posterior", "score", "kept"])

    kind = seen.schema["doc_id"].dataType.simpleString()
    return seen.mapInArrow(run, f"doc_id {kind}, n_words long, posterior double, score double, kept boolean")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """Examine, learn and score all rows of docs."""
    seen = examined(docs, id_col, text_col)
    return score(seen, learn(seen, **fit))
