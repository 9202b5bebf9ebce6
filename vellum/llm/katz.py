"""Language model scores with Katz backoff.

An n-gram model of any order over words and text ends, learned from the rows that
`train` accepts.  With h a history of k - 1 words and h' the same without its first:

* P(w | h) = d(c) c(h, w) / c(h) where h w was seen c times, with Good-Turing
  discounts d of its own for each k, for c up to 5;
* otherwise alpha(h) P(w | h'), evaluated in the same way, down to
* P(w) = d(c) c(w) / N, and what is left goes to one type for all unseen words.

alpha(h) hands the mass that discounting frees to the words not seen after h, normalised
exactly: it is that mass over one less the sum of P(w | h') over the words seen after h.
If all counts after h are over 5 there is nothing to discount; its counts are then
scaled by c(h) / (c(h) + 1).  A history that was never seen gives P(w | h').  Histories
reach back to the text's start and count it as one word.

Scale.  Texts are written once as blocks, a file each: word ids, hashes of their words,
document ids and lengths; no text is shuffled, only what is asked and answered.  A block asks for counts level by level, with one shuffle each: its distinct
keys go to hash buckets as packed arrays, a bucket adds up what all blocks report,
stores its part of the level's count table, and answers each block in the order it
asked.  Answers also number the keys (words by falling count, longer keys bucket after
bucket), so that a level's histories are numbers of the level below, and keys travel and
are stored as sorted, difference-coded numbers.  A key, however frequent, is one entry
for each block.  Keys are dealt by their history, from order 3 on in runs of neighbouring
histories, which lie closer than scattered ones; so a bucket can sum up alpha(h): a word seen after h was
seen after h' too, so its P(w | h') follows from its count one level below, which
travels along, and from c(h'), which the block knows.  Histories with over a thousandth
of all tokens (fewer than a thousand) are dealt by the whole key, and their sums, one
row for each, go through the driver.  Buckets and blocks have a bounded number of
entries; their number, and that of the tasks, grows with the input.  Counts cover all
training rows.

Ids of any type come back as they were; a null id is kept.  A null text is empty: its one token is the end.  A text of any length is part of one
block.  Rows that repeat count and score as often as they occur.  Without training rows
every token is unseen, at probability 1.  An empty table gives an empty result.  Only
the id and the text are read, and what `train` looks at, whatever other columns are
called.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import drop, scratch, small_batches, utf8, written

K = 5
ORDER = 3
END, START = 0, 1  #: ids in each block; their hashes are those of no word
SPECIAL = [b" end", b" start"]


@cache
def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


@cache
def _unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _planes(a: np.ndarray) -> list[bytes]:
    """The lowest byte of each number, then the next; numpy shifts and narrows faster than it gathers bytes."""
    if a.dtype.kind == "u":
        return [(a >> a.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(a.dtype.itemsize)]
    v = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize)
    return [v[:, i].tobytes() for i in range(a.dtype.itemsize)] if len(a) else []


def pack(*arrays: np.ndarray) -> bytes:
    """Little-endian arrays as one compressed string; bytes of equal weight lie side by side."""
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    return _packer().compress(b"".join([len(head).to_bytes(4, "little"), head, *(x for a in arrays for x in _planes(a))]))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = _unpacker().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for kind, size in json.loads(raw[4 : 4 + n]):
        t = np.dtype(kind)
        v = np.empty((size, t.itemsize), dtype=np.uint8)
        for i in range(t.itemsize):
            v[:, i] = np.frombuffer(raw, np.uint8, size, at + i * size)
        out.append(v.reshape(-1).view(t))
        at += size * t.itemsize
    return out


def discounts(n: list[int], k: int = K) -> np.ndarray:
    """d[0..k], d[0] unused, from the numbers n[1..k + 1] of types seen 1 to k + 1 times.

    Where the counts are too thin for Good-Turing (a d outside 0 to 1), d = (r - 1/2) / r.
    """
    plain = np.array([1.0] + [(r - 0.5) / r for r in range(1, k + 1)])
    if n[1] <= 0 or any(x <= 0 for x in n[1 : k + 1]):
        return plain
    a = (k + 1) * n[k + 1] / n[1]
    d = np.array([1.0] + [((r + 1) * n[r + 1] / (n[r] * r) - a) / (1 - a) if a != 1 else -1.0 for r in range(1, k + 1)])
    return d if ((d[1:] > 0) & (d[1:] < 1)).all() else plain


@dataclass(frozen=True)
class Unigram:
    """P of a word that was seen c times in training."""

    total: int
    types: int
    d: np.ndarray
    unseen: float
    scale: float

    @classmethod
    def of(cls, total: int, types: int, n: list[int]) -> Unigram:
        d = discounts(n)
        if not total:
            return cls(0, 0, d, 1.0, 1.0)
        left = sum(n[r] * r * (1 - d[r]) for r in range(1, K + 1)) / total
        unseen = max(left, 1 / (total + 1))
        return cls(total, types, d, unseen, (1 - unseen) / (1 - left) if left < 1 else 0.0)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(c))
        p = self.d[np.minimum(c, K) * (c <= K)] * c / self.total * self.scale
        return np.where(c > 0, p, self.unseen)


def small(a: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the narrower type that holds them."""
    return a.astype(np.uint32 if not len(a) or a.max() < 1 << 32 else np.uint64)


def steps(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers that ascend within runs, as differences; the runs' first ones stay whole."""
    d = np.diff(a, prepend=a[:1])
    d[first] = a[first]
    return d


def unsteps(d: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Undo steps, for runs of these lengths."""
    x = np.cumsum(d.astype(np.uint64))
    begin = np.r_[0, np.cumsum(runs.astype(np.int64))[:-1]] if len(runs) else np.zeros(0, dtype=np.int64)
    before = np.where(begin > 0, x[np.maximum(begin - 1, 0)], 0).astype(np.uint64) if len(runs) else np.zeros(0, dtype=np.uint64)
    return x - np.repeat(before, runs)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread hashes anew, so that buckets do not follow from the order of hashes."""
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _blocks(folder: str, hashes: str, block_words: int):
    """mapInArrow body: (doc_id, text, train) to blocks, a file each; a row tells its name and tokens.

    The words' hashes, needed until words are counted, are files of their own; the block
    keeps their order.  START, never a token, stands for a word not met before in the
    block.  Names are unique to the attempt, so a task that is lost and run again leaves
    no block twice: only those in the committed table count.
    """

    class Ids(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = n = len(self)
            return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = [pafs.FileSystem.from_uri(f) for f in (folder, hashes)]
        for store, path in stores:
            store.create_dir(path, recursive=True)
        ids, parts, lengths, train, names = Ids(), [], [], [], []
        ids.update({w: i for i, w in enumerate(SPECIAL)})

        def flush() -> pa.RecordBatch:
            h = np.array([xxhash.xxh64_intdigest(w, 7) for w in ids], dtype=np.uint64)
            order = np.argsort(h, kind="stable")
            order = order[order != START]
            tok = np.concatenate(parts)
            fresh = np.diff(np.maximum.accumulate(np.r_[START, tok])) > 0
            data = pack(small_type(order, len(ids)), small_type(np.where(fresh, START, tok), len(ids)), np.array(lengths, dtype=np.uint32), np.array(train, dtype=np.uint8), *_packed_ids(names))
            name = uuid.uuid4().hex
            for (store, path), content in zip(stores, (data, pack(np.diff(h[order], prepend=np.uint64(0)))), strict=True):
                with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                    out.write(content)
            made = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(tok)], pa.int64())], names=["block", "tokens"])
            ids.clear()
            ids.update({w: i for i, w in enumerate(SPECIAL)})
            for x in (parts, lengths, train, names):
                x.clear()
            return made

        held = 0
        for batch in batches:
            for doc_id, text, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = utf8(text).lower().split()
                parts.append(np.array([*map(ids.__getitem__, words), END], dtype=np.int32))
                lengths.append(len(words) + 1)
                train.append(bool(t))
                names.append(doc_id)
                held += len(words) + 1
                if held >= block_words:
                    yield flush()
                    held = 0
        if lengths:
            yield flush()

    return run


def _distinct(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers below size, ascending, and the place of each number among them.

    Numbers that leave room for their position are sorted together with it, which is
    faster than sorting positions by them.
    """
    bits = max(1, len(code)).bit_length()
    if size >= 1 << (64 - bits):
        return np.unique(code, return_inverse=True)
    both = np.sort(code.astype(np.uint64) << np.uint64(bits) | np.arange(len(code), dtype=np.uint64))
    ordered = (both >> np.uint64(bits)).astype(np.int64)
    fresh = np.r_[True, ordered[1:] != ordered[:-1]][: len(code)]
    at = np.empty(len(code), dtype=np.int64)
    at[(both & np.uint64((1 << bits) - 1)).astype(np.int64)] = np.cumsum(fresh) - 1
    return ordered[fresh], at


def _packed_ids(ids: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids as bytes and their lengths, one more than that; 0 for null."""
    raw = [None if x is None else str(x).encode("utf-8", "surrogatepass") for x in ids]
    return np.frombuffer(b"".join(x or b"" for x in raw), np.uint8), np.array([0 if x is None else len(x) + 1 for x in raw], dtype=np.uint32)


def _unpacked_ids(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    raw, ends = data.tobytes(), np.cumsum(np.maximum(sizes.astype(np.int64), 1) - 1)
    return pa.array([raw[e - n + 1 : e].decode("utf-8", "surrogatepass") if n else None for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.string())


def small_type(a: np.ndarray, size: int) -> np.ndarray:
    """Numbers below size in the narrowest type."""
    return a.astype(np.uint16 if size <= 1 << 16 else np.uint32)


def _fetch(folder: str):
    """A function from a block's name to its file's content."""
    store, path = pafs.FileSystem.from_uri(folder)

    def fetch(name: str) -> bytes:
        with store.open_input_file(f"{path}/{name}") as f:
            return f.read()

    return fetch


class Block:
    """A block's tokens, and its distinct words and longer keys in the order they are asked for."""

    def __init__(self, data: bytes):
        order, tok, length, train, *names = unpack(data)
        self.order = order.astype(np.int64)  #: word ids by hash, the order they are asked for
        self.types = len(order) + 1
        self.tok, self.length = tok.astype(np.int32), length.astype(np.int64)
        fresh = self.tok == START
        self.tok[fresh] = START + np.arange(1, fresh.sum() + 1)
        self.docs = _unpacked_ids(*names)
        self.begin = np.r_[0, np.cumsum(self.length)[:-1]].astype(np.int64)
        self.train = np.repeat(train.astype(bool), self.length)
        #: Place of each token in its text.
        self.place = np.arange(len(self.tok)) - np.repeat(self.begin, self.length)

    def counts(self) -> np.ndarray:
        """Training counts of the words, in the order they are asked for."""
        return np.bincount(self.tok, weights=self.train, minlength=self.types).astype(np.int64)[self.order]


@dataclass
class Below:
    """What a block knows of the keys of one level: their words, counts and numbers, P by key, and the key at each token.

    `base` is what counts are divided by, a history's count but for scaling; it is asked
    for by the key's history.  Token places before `since` have no key of this level.
    """

    word: np.ndarray
    count: np.ndarray
    number: np.ndarray
    p: np.ndarray
    base: np.ndarray
    at: np.ndarray
    since: int


class Keys:
    """A block's distinct keys of one level above `below`: history, word, training count, bucket starts, and the key at each token."""

    def __init__(self, block: Block, below: Below, words: Below, level: int, buckets: int, run: int, hot: np.ndarray):
        if level == 2:
            hist = np.where(block.place > 0, np.r_[0, block.tok[:-1]], START)
            self.since = 0
        else:  # the key below that ended at the token before
            hist = np.r_[0, below.at[:-1]]
            self.since = below.since + 1
        self.live = block.place >= self.since
        # histories and words by the rank of their numbers, so that keys sort as they are asked for
        h_order, w_order = np.argsort(below.number), np.argsort(words.number)  # no two are equal
        rank_h, rank_w = np.empty(len(h_order), dtype=np.int64), np.empty(len(w_order), dtype=np.int64)
        rank_h[h_order], rank_w[w_order] = np.arange(len(h_order)), np.arange(len(w_order))
        size = max(1, len(w_order))
        code, at = _distinct(rank_h[hist[self.live]] * size + rank_w[block.tok[self.live]], len(h_order) * size)
        of_h = code // size
        h, w = h_order[of_h], w_order[code - of_h * size]
        n = np.bincount(at, weights=block.train[self.live], minlength=len(code)).astype(np.int64)
        hn, wn = below.number[h], words.number[w]
        spread = _mix(hn // np.uint64(run))
        for i, j in zip(np.searchsorted(hn, hot, "left").tolist(), np.searchsorted(hn, hot, "right").tolist(), strict=True):  # hn ascends
            spread[i:j] = _mix(hn[i:j] ^ _mix(wn[i:j]))
        bucket = small_type((spread % np.uint64(buckets)).astype(np.int64), buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.hist, self.word, self.n, self.hist_number, self.word_number = h[order], w[order], n[order], hn[order], wn[order]
        self.start = np.searchsorted(bucket[order], np.arange(buckets + 1))
        self.at = np.zeros(len(block.tok), dtype=np.int64)
        self.at[self.live] = place[at]
        # the key one level below of each: the word itself, or the shorter key that ends at the same token
        if level == 2:
            self.low = self.word
        else:
            self.low = np.zeros(len(order), dtype=np.int64)
            self.low[self.at[self.live]] = below.at[self.live]

    def parts(self):
        """(bucket, from, to) of the buckets asked."""
        return ((b, i, j) for b, (i, j) in enumerate(zip(self.start[:-1].tolist(), self.start[1:].tolist(), strict=True)) if i < j)


ASKED = "bucket int, block string, data binary"
ANSWER = "kind string, bucket int, block string, data binary"


def _rows(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


ASKED_KINDS = [pa.int32(), pa.string(), pa.binary()]
ANSWER_KINDS = [pa.string(), *ASKED_KINDS]
ASKED_NAMES, ANSWER_NAMES = ["bucket", "block", "data"], ["kind", "bucket", "block", "data"]


@dataclass(frozen=True)
class Level:
    """What the driver knows of a level once its counts are there."""

    buckets: int
    run: int  #: histories of neighbouring numbers, so many, are dealt together
    offset: np.ndarray  #: number of the first key of each bucket, and of the first after the last; of words, that of the text's start alone
    d: np.ndarray
    hot: np.ndarray  #: numbers of the histories, one level below, that are dealt by the whole key
    hot_sum: np.ndarray  #: of P over the words seen after each, but for its base
    hot_m: np.ndarray  #: how many words were seen once, twice, ... after each


def _ask_words(folder: str, hashes: str, buckets: int):
    """mapInArrow body: blocks to what they ask of the words' buckets, which are ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch, fetch_hashes = _fetch(folder), _fetch(hashes)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                n = Block(fetch(name)).counts()
                h = np.cumsum(unpack(fetch_hashes(name))[0])
                start = np.searchsorted((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
                yield _rows(ASKED_NAMES, [(b, name, pack(np.diff(h[i:j], prepend=np.uint64(0)), n[i:j].astype(np.uint32))) for b, (i, j) in enumerate(zip(start[:-1], start[1:], strict=True)) if i < j], ASKED_KINDS)

    return run


def _top(c: np.ndarray, least: int = 1000) -> bytes:
    """The most frequent keys of a bucket, for the choice of hot histories."""
    top = np.argsort(-c, kind="stable")[:least]
    return pack(top.astype(np.uint64), c[top])


def _add_words(asked: pa.Table) -> pa.Table:
    """A bucket's words: totals, the table's part, and each block's answer, ranks by count and the count of each rank."""
    bucket = asked.column("bucket")[0].as_py()
    parts = [unpack(x) for x in asked.column("data").to_pylist()]
    h, at = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
    c = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
    seen = c > 0
    stats = {"bucket": bucket, "size": len(h), "types": int(seen.sum()), "total": int(c.sum()), "n": np.bincount(np.minimum(c[seen], K + 2), minlength=K + 3).tolist()[: K + 2]}
    by_count = np.argsort(-c, kind="stable")
    rank = np.empty(len(h), dtype=np.uint64)
    rank[by_count] = np.arange(len(h))
    falls = c[by_count]
    first = np.flatnonzero(np.r_[True, falls[1:] != falls[:-1]])
    rows = [("stats", bucket, None, json.dumps(stats).encode()), ("table", bucket, None, pack(np.diff(h[seen], prepend=np.uint64(0)), small(c[seen]))), ("top", bucket, None, _top(falls))]
    k = 0
    for name, p in zip(asked.column("block").to_pylist(), parts, strict=True):
        own = rank[at[k : k + len(p[0])]]
        rows.append(("answer", bucket, name, pack(small(own), first.astype(np.uint32), falls[first])))
        k += len(p[0])
    return pa.Table.from_batches([_rows(ANSWER_NAMES, rows, ANSWER_KINDS)])


def _known_words(block: Block, answers: list[dict], level: Level, unigram: Unigram, train_docs: int) -> Below:
    """The words of a block; the text's start is numbered last, and occurs as often as there are texts."""
    c, number = np.zeros(block.types, dtype=np.int64), np.full(block.types, level.offset[-1], dtype=np.uint64)
    parts = [(a["bucket"], *unpack(a["data"])) for a in sorted(answers, key=lambda a: a["bucket"])]
    assert sum(len(p[1]) for p in parts) == len(block.order), "an answer is missing"
    c[block.order] = np.concatenate([falls[np.searchsorted(first, rank, "right") - 1] for _, rank, first, falls in parts])
    number[block.order] = np.concatenate([_word_number(rank, b, level.buckets) for b, rank, _, _ in parts])
    p = unigram(c)
    c = c.copy()
    c[START] = train_docs
    return Below(np.arange(len(c)), c, number, p, np.ones(len(c)), block.tok.astype(np.int64), 0)


def _word_number(rank: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Words are numbered by their rank first: frequent ones get small numbers, which take little room in keys."""
    return rank.astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket)


def _known(block: Block, keys: Keys, answers: list[dict], below: Below, level: Level) -> Below:
    """Counts, numbers and P of a block's keys, from their buckets' answers and from one level below."""
    by = {a["bucket"]: a["data"] for a in answers}
    n = len(keys.word)
    p, count, number, base_of = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint64), np.ones(n)
    d, hot = level.d, level.hot
    for b, i, j in keys.parts():
        c, whole, need, sums, own, *m = unpack(by[b])
        c = c.astype(np.int64)
        h, low = keys.hist[i:j], keys.low[i:j]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        run_of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, j - i]))
        hn, ch = below.number[h[first]], below.count[h[first]]
        k = np.searchsorted(hot, hn)
        is_hot = (k < len(hot)) & (hot[np.minimum(k, max(0, len(hot) - 1))] == hn) if len(hot) else np.zeros(len(hn), dtype=bool)
        total, ms = np.zeros(len(first)), np.zeros((K, len(first)))
        total[need], ms[:, need] = sums, np.stack(m)
        total[is_hot], ms[:, is_hot] = level.hot_sum[k[is_hot]], level.hot_m[:, k[is_hot]]
        whole = np.where(is_hot, ms.sum(0) == 0, whole.astype(bool))
        # what discounting frees, and alpha; all words after one history share the base one level below
        freed = np.where(whole, 1.0, ((1 - d[1:, None]) * ms * np.arange(1, K + 1)[:, None]).sum(0))
        base = np.maximum(ch + whole, 1)
        alpha = np.where(ch > 0, freed / base / np.maximum(1 - total / below.base[low[first]], 1e-300), 1.0)
        p[i:j] = np.where(c > 0, d[np.minimum(c, K) * (c <= K)] * c / base[run_of], alpha[run_of] * below.p[low])
        count[i:j], base_of[i:j] = c, base[run_of]
        if len(own):
            number[i:j] = np.cumsum(own.astype(np.uint64)) + level.offset[b]
    return Below(keys.word, count, number, p, base_of, keys.at, keys.since)


def _climb(block: Block, answers: list[dict], levels: list[Level], unigram: Unigram, train_docs: int) -> tuple[Below, Below, np.ndarray]:
    """What the block knows of words and of the highest level answered, and each token's P there."""
    told: list[list] = [[] for _ in levels]
    for a in answers:
        told[a["level"]].append(a)
    words = below = _known_words(block, told[0], levels[0], unigram, train_docs)
    p = words.p[block.tok]
    for k, level in enumerate(levels[1:], 1):
        keys = Keys(block, below, words, k + 1, level.buckets, level.run, level.hot)
        below = _known(block, keys, told[k], below, level)
        p[keys.live] = below.p[keys.at[keys.live]]  # a text's first words have no longer history
    return words, below, p


def _ask(folder: str, levels: list[Level], buckets: int, run_length: int, hot: np.ndarray, unigram: Unigram, train_docs: int):
    """mapInArrow body: blocks with the answers so far to what they ask on the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = _fetch(folder)
        for batch in batches:
            for name, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block(fetch(name))
                words, below, _ = _climb(block, answers, levels, unigram, train_docs)
                keys = Keys(block, below, words, len(levels) + 1, buckets, run_length, hot)
                rows = []
                for b, i, j in keys.parts():
                    first = np.flatnonzero(np.r_[True, keys.hist[i + 1 : j] != keys.hist[i : j - 1]])
                    heads = keys.hist_number[i:j][first]
                    rows.append((b, name, pack(small(np.diff(heads, prepend=np.uint64(0))), np.diff(np.r_[first, j - i]).astype(np.uint32), small(steps(keys.word_number[i:j], first)), keys.n[i:j].astype(np.uint32), small(np.where(keys.n[i:j] > 0, below.count[keys.low[i:j]], 0)))))
                yield _rows(ASKED_NAMES, rows, ASKED_KINDS)

    return run


def _by_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """An order by v, then w; as one number where that fits."""
    top = int(w.max()) + 1
    if int(v.max()) < (1 << 64) // top - 1:
        return np.argsort(v.astype(np.uint64) * np.uint64(top) + w.astype(np.uint64))
    return np.lexsort((w, v))


def _add(weight, hot: np.ndarray, last: bool):
    """applyInArrow body for one level; weight: P of a word by its count one level below, but for its base."""

    def run(asked: pa.Table) -> pa.Table:
        """A bucket's keys: totals, the table's part, sums of hot histories, and each block's answer."""
        bucket = asked.column("bucket")[0].as_py()
        parts = [unpack(x) for x in asked.column("data").to_pylist()]
        parts = [[np.cumsum(p[0].astype(np.uint64)), *p[1:]] for p in parts]
        v = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        w = np.concatenate([unsteps(p[2], p[1]) for p in parts])
        order = _by_key(v, w)
        vs, ws = v[order], w[order]
        first = np.flatnonzero(np.r_[True, (vs[1:] != vs[:-1]) | (ws[1:] != ws[:-1])])
        of = np.empty(len(order), dtype=np.int64)
        of[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
        c = np.bincount(of, weights=np.concatenate([p[3] for p in parts])).astype(np.int64)
        vs, ws = vs[first], ws[first]
        low = np.maximum.reduceat(np.concatenate([p[4] for p in parts])[order], first).astype(np.int64)  # 0 from blocks that did not learn the key
        # sums by history: how many words follow it once, twice, ... and their P together
        begin = np.r_[True, vs[1:] != vs[:-1]]
        hist, group = vs[begin], np.cumsum(begin) - 1
        seen = c > 0
        few = seen & (c <= K)
        m = np.bincount((c[few] - 1) * len(hist) + group[few], minlength=K * len(hist)).reshape(K, len(hist))
        sums = np.bincount(group, weights=np.where(seen, weight(low), 0.0), minlength=len(hist))
        is_hot = np.isin(hist, hot)
        n = np.bincount(np.minimum(c[seen], K + 2), minlength=K + 3).tolist()[: K + 2]
        runs = np.flatnonzero(np.r_[True, vs[seen][1:] != vs[seen][:-1]]) if seen.any() else np.zeros(0, dtype=np.int64)
        rows = [
            ("stats", bucket, None, json.dumps({"bucket": bucket, "size": len(first), "n": n}).encode()),
            ("table", bucket, None, pack(small(np.diff(vs[seen][runs], prepend=np.uint64(0))), np.diff(np.r_[runs, seen.sum()]).astype(np.uint32), small(steps(ws[seen], runs)), small(c[seen]))),
            ("hot", bucket, None, pack(hist[is_hot], sums[is_hot], *(x[is_hot] for x in m))),
        ]
        if not last:
            rows.append(("top", bucket, None, _top(c)))
        k = 0
        for name, p in zip(asked.column("block").to_pylist(), parts, strict=True):
            own = of[k : k + len(p[2])]
            k += len(p[2])
            counts = c[own]
            run_of = np.repeat(np.arange(len(p[0])), p[1])
            g = group[own[np.cumsum(p[1]) - p[1]]]
            # histories with a key that was never seen need their sums; all need to know whether nothing was discounted
            need = np.flatnonzero((np.bincount(run_of, weights=counts == 0, minlength=len(p[0])) > 0) & ~is_hot[g])
            whole = (m[:, g].sum(0) == 0).astype(np.uint8)
            number = small(np.diff(own.astype(np.uint64), prepend=np.uint64(0))) if not last else np.zeros(0, dtype=np.uint32)  # ascends, as the keys asked for do
            rows.append(("answer", bucket, name, pack(small(counts), whole, need.astype(np.uint32), sums[g[need]], number, *(x[g[need]].astype(np.uint32) for x in m))))
        return pa.Table.from_batches([_rows(ANSWER_NAMES, rows, ANSWER_KINDS)])

    return run


def _score(folder: str, levels: list[Level], unigram: Unigram, train_docs: int):
    """mapInArrow body: blocks with all answers to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = _fetch(folder)
        for batch in batches:
            for name, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block(fetch(name))
                words, _, p = _climb(block, answers, levels, unigram, train_docs)
                c = words.count[block.tok]
                base_log = np.log10((c + 0.1) / (unigram.total + 0.1 * (unigram.types + 1))) if unigram.total else np.zeros(len(c))
                sums = [np.add.reduceat(x, block.begin) for x in ((c > 0).astype(np.int64), base_log, np.log10(p))]
                yield pa.RecordBatch.from_arrays([block.docs, pa.array(block.length), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def _hot(told: DataFrame, number, least: float) -> np.ndarray:
    """Numbers of the keys that occur more often than that; number: of places in a bucket."""
    found = [np.zeros(0, dtype=np.uint64)]
    for r in told.where("kind = 'top'").select("bucket", "data").toLocalIterator():
        at, c = unpack(bytes(r["data"]))
        found.append(number(at[c > least], r["bucket"]))
    return np.concatenate(found)


def _summary(told: DataFrame, buckets: int) -> tuple[list[dict], np.ndarray]:
    """The buckets' totals, and the number of each bucket's first key."""
    stats = [json.loads(bytes(r["data"])) for r in told.where("kind = 'stats'").select("data").toLocalIterator()]
    sizes = np.zeros(buckets, dtype=np.uint64)
    for x in stats:
        sizes[x["bucket"]] = x["size"]
    return stats, np.r_[np.uint64(0), np.cumsum(sizes)].astype(np.uint64)


def score(docs: DataFrame, train: Column, order: int = ORDER, block_words: int = 800_000, bucket_entries: int = 1_000_000, hot_share: float = 1e-3) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for docs(doc_id, text); train tells the rows to learn from.

    order: words of a key, its history and itself, 2 or more.  block_words and
    bucket_entries bound what a task holds; they do not change results.
    """
    if order < 2:
        raise ValueError("a backoff model has order 2 or more")
    spark = docs.sparkSession
    small_batches(spark)
    folder, hashes = scratch(spark, "katz-texts"), scratch(spark, "katz-hashes")
    blocks = written(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train")).mapInArrow(_blocks(folder, hashes, block_words), "block string, tokens long"), "katz-blocks")
    spark_rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a block is large
    try:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tokens, n_blocks = blocks.select(F.sum("tokens"), F.count("*")).first()
        tokens = tokens or 0
        tasks = max(least, -(-n_blocks // 2))
        train_docs = docs.where(F.coalesce(train, F.lit(False))).count()

        def with_answers(tables: list[DataFrame]) -> DataFrame:
            """Each block's name and the answers it got, one for each level and bucket; each block has its end of text answered."""
            told = reduce(DataFrame.unionAll, (t.where("kind = 'answer'").select("block", F.struct(F.lit(k).alias("level"), "bucket", "data").alias("answer")) for k, t in enumerate(tables)))
            return told.repartition(tasks, "block").groupBy("block").agg(F.collect_list("answer").alias("answers"))

        def gathered(asked: DataFrame, buckets: int, add, name: str) -> DataFrame:
            return written(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(add, ANSWER), name, "kind")

        buckets = max(least, -(-tokens // (2 * bucket_entries)))
        tables = [gathered(blocks.select("block").repartition(tasks).mapInArrow(_ask_words(folder, hashes, buckets), ASKED), buckets, _add_words, "katz-1")]
        drop(spark, hashes)
        stats, _ = _summary(tables[0], buckets)
        unigram = Unigram.of(sum(s["total"] for s in stats), sum(s["types"] for s in stats), [sum(s["n"][r] for s in stats) for r in range(K + 2)])
        none = np.zeros(0)
        start = np.array([buckets * max((s["size"] for s in stats), default=0)], dtype=np.uint64)  # over all words' numbers
        levels = [Level(buckets, 1, start, none, none, none, none)]
        hot = np.unique(np.r_[_hot(tables[0], partial(_word_number, buckets=buckets), hot_share * max(1, unigram.total)), start])  # fewer than 1 / hot_share words, and the text's start
        weight = unigram
        buckets = max(least, -(-tokens // bucket_entries))
        for k in range(2, order + 1):
            run = 1 if k == 2 else max(1, bucket_entries // 64)  # words are numbered by frequency, which must not gather
            asked = with_answers(tables).mapInArrow(_ask(folder, levels, buckets, run, hot, unigram, train_docs), ASKED)
            tables.append(gathered(asked, buckets, _add(weight, hot, k == order), f"katz-{k}"))
            stats, offset = _summary(tables[-1], buckets)
            d = discounts([sum(s["n"][r] for s in stats) for r in range(K + 2)])
            hot_sum, hot_m = np.zeros(len(hot)), np.zeros((K, len(hot)))
            for r in tables[-1].where("kind = 'hot'").select("data").toLocalIterator():
                h, p, *m = unpack(bytes(r["data"]))
                at = np.searchsorted(hot, h)
                hot_sum[at] += p
                hot_m[:, at] += np.stack(m) if len(h) else np.zeros((K, 0))
            levels.append(Level(buckets, run, offset, d, hot, hot_sum, hot_m))
            if k < order:
                hot = np.unique(_hot(tables[-1], lambda at, b: at + levels[-1].offset[b], hot_share * max(1, unigram.total)))
                weight = _discounted(d)
        out = written(with_answers(tables).mapInArrow(_score(folder, levels, unigram, train_docs), "doc_id string, n_tokens long, n_known long, base_score double, score double"), "katz-scores")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", spark_rows)
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_tokens", "n_known", F.lit(unigram.total).cast("long").alias("train_tokens"), "base_score", "score")


def _discounted(d: np.ndarray):
    """The discounted count of a key that was seen c times."""
    return lambda c: d[np.minimum(c, K) * (c <= K)] * c
