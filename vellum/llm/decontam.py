"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every word sequence of the normalised benchmark items.  Document
words stream through it; at each word it knows the longest suffix that some item
contains.  A length of `window` or more is a hit of the last `window` words; an item
shorter than that is hit when its whole text ends here.

Normal form: A-Z to lower case; words are maximal runs of ASCII letters, digits and
code points above 0x7F.

Scale.  The items reach the driver in chunks of at most `chunk_words` words, one after
the other, and a worker holds the automaton of one chunk at a time, whatever the
benchmark's size.  With one chunk the documents are read once and never shuffled.  With
more they are written once, numbered, and read once for each chunk, which writes the spans of
what it hits and no text; what was hit then meets the documents by number.

Nulls: a null text or item has no words.  An item without words never hits.  An item
without an id hits words, but is neither counted nor named.  Items that repeat all
count; those that share an id are one.  An empty benchmark contaminates nothing, an
empty table of documents gives an empty result.  A share of exactly `coverage` is
contaminated: n_hit > 0 and n_hit / n_words at or over it.  A text of any length is
held as its words.  Other columns are carried along whole, whatever they are called.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import small_batches, utf8, written

WINDOW = 13
#: A word, before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes to their normal form; what is no word byte becomes a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton of the items' words."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: State of a whole window, or state and length of a short item, to the items that hold it.
        self.windows: dict[int, set] = {}
        self.shorts: dict[int, dict[int, set]] = {}
        for item, codes in coded:
            if len(codes) < window:
                s = 0
                for c in codes:
                    s = self.next[s][c]
                self.shorts.setdefault(s, {}).setdefault(len(codes), set()).add(item)
                continue
            s = n = 0
            for c in codes:
                s, n = self.step(s, n, c)
                if n >= window:
                    self.windows.setdefault(self.cut(s), set()).add(item)
        self.near_short = [None] * len(self.next)  # the nearest state on the suffix path with short items
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.near_short[s] = s if s in self.shorts else (self.near_short[self.link[s]] if s else None)
        self.cuts: dict[int, int] = {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def step(self, s: int, n: int, c: int) -> tuple[int, int]:
        """State and matching length after one more word."""
        nxt = self.next
        while s and c not in nxt[s]:
            s = self.link[s]
            n = self.length[s]
        t = nxt[s].get(c)
        return (0, 0) if t is None else (t, n + 1)

    def cut(self, s: int) -> int:
        """The state of the last `window` words of s."""
        while self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans [start, end) of word positions, joined where they touch, and the items hit."""
        spans: list[list[int]] = []
        items: set = set()
        nxt, link, length, near, window = self.next, self.link, self.length, self.near_short, self.window
        s = n = 0
        for i, c in enumerate(map(self.vocab.get, words)):
            if c is None:
                s = n = 0
                continue
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            t = nxt[s].get(c)
            if t is None:
                s = n = 0
                continue
            s = t
            n += 1
            reach = 0
            if n >= window:
                at = self.cuts.get(s)
                if at is None:
                    at = self.cuts[s] = self.cut(s)
                items |= self.windows.get(at, set())
                reach = window
            x = near[s]
            while x is not None and x > 0:
                for k, of in self.shorts[x].items():
                    if k <= n:
                        items |= of
                        reach = max(reach, k)
                x = near[link[x]]
            if reach:
                a = i + 1 - reach
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append([a, i + 1])
        return [(a, b) for a, b in spans], items


_BUILT: dict[str, Automaton] = {}


def _automaton(key: str, items, window: int) -> Automaton:
    """One automaton for each Python worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, window)
    return _BUILT[key]


def _joined(spans: list[list[int]]) -> list[list[int]]:
    """Sorted spans, joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(map(list, spans)):
        if out and out[-1][1] >= a:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


HITS = ["__n_words", "__spans", "__items"]
HIT_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]


def _scan(rows: DataFrame, at: int, items: list[tuple[object, list[bytes]]], window: int) -> DataFrame:
    """Adds the hits of these items to the last three columns; the text is column `at`."""
    key = hashlib.sha256(repr((window, items)).encode()).hexdigest()
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(key, shared.value, window)
        for batch in batches:
            lengths, spans, names = [], batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for i, text in enumerate(batch.column(at).to_pylist()):
                words = words_of(text)
                lengths.append(len(words))
                own, of = auto.hits(words)
                if own:
                    before = spans[i]
                    spans[i] = [x for ab in (_joined([*own, *zip(before[::2], before[1::2], strict=True)]) if before else own) for x in ab]
                    names[i] = sorted({*names[i], *(str(x) for x in of if x is not None)})
            hits = [pa.array(x, k) for x, k in zip((lengths, spans, names), HIT_KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: batch.num_columns - 3], *hits], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _chunks(items: DataFrame, chunk_words: int, item_id: str, item_text: str) -> Iterator[list]:
    """The items' words, in chunks for one automaton each; the driver holds one chunk and one partition of the items."""
    chunk: list = []
    size = 0
    for row in items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).orderBy("i", "t").toLocalIterator():
        words = words_of(row["t"])
        if size and size + len(words) > chunk_words:
            yield chunk
            chunk, size = [], 0
        if words:
            chunk.append((row["i"], words))
            size += len(words)
    yield chunk


def _hits_of(rows: DataFrame, items: list[tuple[object, list[bytes]]], window: int) -> DataFrame:
    """__row, spans and items of those of rows(__row, text) that the items hit; texts stay behind."""
    key = hashlib.sha256(repr((window, items)).encode()).hexdigest()
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(key, shared.value, window)
        for batch in batches:
            found = []
            for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, of = auto.hits(words_of(text))
                if own:
                    found.append((row, [x for ab in own for x in ab], sorted({str(x) for x in of if x is not None})))
            cols = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), *HIT_KINDS[1:]], strict=True)], names=["__row", *HITS[1:]])

    return rows.mapInArrow(run, f"__row long, {HITS[1]} array<bigint>, {HITS[2]} array<string>")


def _merged(spans: pd.Series) -> pd.Series:
    return pd.Series([[x for ab in _joined(list(zip(s[::2], s[1::2], strict=True))) for x in ab] for s in spans], dtype=object)


def _hit(docs: DataFrame, items: DataFrame, window: int, chunk_words: int, text_col: str, item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """docs, columns c0, c1 and so on, with the number of words, the hit spans and the items hit as last three columns.

    Items of one chunk are looked for as the rows pass by.  For more, the rows are written
    once, with a number each, and read once for each chunk; a chunk writes the spans of the rows it
    hits and nothing else, and these are joined with the rows in the end (by broadcast
    up to `broadcast_rows` rows that are hit).
    """
    small_batches(docs.sparkSession)
    none = [F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<string>)")]
    rows, at = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), docs.columns.index(text_col)
    chunks = _chunks(items, chunk_words, item_id, item_text)
    first, second = next(chunks), next(chunks, None)
    if second is None:
        return _scan(rows.select("*", F.lit(0).cast("long").alias(HITS[0]), *(e.alias(c) for c, e in zip(HITS[1:], none, strict=True))), at, first, window)
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "decontamination")
    texts = rows.select("__row", f"c{at}")
    parts = [written(_hits_of(texts, chunk, window), "decontamination-spans") for chunk in itertools.chain((first, second), chunks)]
    joined = F.pandas_udf(_merged, "array<bigint>")
    per = reduce(DataFrame.unionAll, parts).groupBy("__row").agg(F.flatten(F.collect_list(HITS[1])).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(HITS[2])))).alias(HITS[2]))  # at most one row of each chunk
    per = written(per.select(F.col("__row").alias("__hit"), joined("s").alias(HITS[1]), HITS[2]), "decontamination-hits")
    per = F.broadcast(per) if per.count() <= broadcast_rows else per
    n = F.coalesce(F.regexp_count(f"c{at}", F.lit(WORD)), F.lit(0)).cast("long").alias(HITS[0])
    out = rows.join(per, rows["__row"] == per["__hit"], "left")
    return out.select(*(f"c{i}" for i in range(len(docs.columns))), n, *(F.coalesce(c, e).alias(c) for c, e in zip(HITS[1:], none, strict=True)))


#: Words in the spans, whose starts and ends alternate.
N_HIT = "aggregate(__spans, struct(0L as n, -1L as sign), (a, x) -> struct(a.n + a.sign * x as n, -a.sign as sign), a -> a.n)"


def _contaminated(coverage: float):
    """In whole numbers, so that a share of exactly the limit counts."""
    return (F.expr(N_HIT) > 0) & (F.expr(N_HIT) * 10_000 >= F.col(HITS[0]) * round(coverage * 10_000))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.05, chunk_words: int = 300_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items for each document.

    spans holds start and end word positions, alternating.
    """
    found = _hit(docs.select(id_col, text_col), items, window, chunk_words, text_col, item_id, item_text)
    return found.select(
        F.col("c0").alias("doc_id"), F.col(HITS[0]).alias("n_words"), F.expr(N_HIT).alias("n_hit"), F.size(HITS[2]).cast("long").alias("n_items"),
        F.sha2(F.array_join(HITS[2], ",").cast("binary"), 256).alias("items_sha256"), _contaminated(coverage).alias("contaminated"), F.col(HITS[1]).alias("spans"), F.col(HITS[2]).alias("items"),
    )


def cut_spans(text: str | None, spans: list[int]) -> str | None:
    """The text without the words in spans; what separates the rest stays."""
    if text is None or not spans:
        return text
    raw = utf8(text)
    folded, at, k = raw.translate(FOLD), [], 0
    for w in folded.split():
        k = folded.index(w, k)
        at.append((k, k + len(w)))
        k += len(w)
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.05, chunk_words: int = 300_000, text_col: str = "text", cut: bool = False) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated; with cut, their texts without the spans that are hit."""
    found = _hit(docs, items, window, chunk_words, text_col).where(~_contaminated(coverage))
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, spans = batch.columns[: len(names)], batch.column(len(names) + 1).to_pylist()
            if any(spans):
                cols[at] = pa.array([cut_spans(t, s) for t, s in zip(cols[at].to_pylist(), spans, strict=True)], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[: len(names)])

    if cut:
        found = found.mapInArrow(run, found.select(*found.columns[: len(names)]).schema)
    return found.select(*(F.col(f"c{i}") for i in range(len(names)))).toDF(*names)
