"""Collocations by position bitmaps, extended depth first.

Texts are lower-cased (A-Z), parted at marks and line ends into pieces and at blanks into
words; the positions of a shard (some two million words of one language) carry one word
each, and a border lies between pieces.  A word's bitmap has a bit for each of its
positions; of its bytes only those that are not empty are stored, with their places.
A phrase's bitmap marks where it ends: shifted by one position and ANDed with a word's
bitmap it is that of the phrase with the word behind it, its popcount the number of
occurrences; no bit gets over a border, which no word's bitmap has.  First words are taken
in batches, each extended to its full depth before the next, all words behind one
byte of bitmap at once.  Popcounts are summed over shards.

Three passes over the texts, each a sum by key after a partial sum in each task: words,
then pairs of frequent words, then triples of two frequent pairs.  What is frequent
reaches the next pass as a bitmap of hashed keys of a fixed size (2 and 32 MB),
which may let a rare word or pair through, to be dropped by its exact sum, but never
withholds a frequent one.  A word's key is its 64-bit hash with its language; that no two
words share one is checked, and another seed taken if they do, so counts are exact.

Null texts have no words, a null language is `und`.  Texts that repeat count each time.
A text of any length is read in stretches that end at a blank, and a shard in it ends at
a border.  Ties in score go to the higher count, then to the lower phrase by bytes; of
equal cuts the first counts.  An empty table gives an empty result.  Only the text and
the language are read, whatever other columns are called.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import clean, scratch_mark, small_batches, utf8, written

BORDER = b"\xff"  # in no UTF-8
MARKS = b".,;:!?\n\v\f\r"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + MARKS, b"abcdefghijklmnopqrstuvwxyz" + BORDER * len(MARKS))
BLANK = re.compile(rb"[ \t]|" + BORDER)
MASK = (1 << 64) - 1


def words_of(text: str | None, stretch: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text and the borders between its pieces, a stretch at a time."""
    raw, at = utf8(text).translate(FOLD), 0
    while at < len(raw):
        end = BLANK.search(raw, at + stretch) if at + stretch < len(raw) else None
        stop = end.start() if end else len(raw)
        yield raw[at:stop].replace(BORDER, b" " + BORDER + b" ").split()
        at = stop


class Shard:
    """Positions of one language until they are counted."""

    def __init__(self, lang: str):
        self.lang, self.n, self.parts = lang, 0, []
        self.ids = defaultdict(itertools.count(1).__next__, {BORDER: 0})

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.n += len(words)

    def close(self) -> None:
        self.add([BORDER])

    def taken(self, all_of_it: bool) -> tuple[np.ndarray, list[bytes]]:
        """The positions up to the last border, and the words by number; what is behind stays."""
        at = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        names = list(self.ids)
        last = len(at) if all_of_it else int(np.flatnonzero(at == 0)[-1]) + 1 if (at == 0).any() else 0
        rest = [names[i] for i in at[last:].tolist()]
        if last:
            self.__init__(self.lang)
            self.add(rest)
        return at[:last], names


def word_keys(lang: str, names: list[bytes], seed: int) -> np.ndarray:
    """64-bit keys of words of a language, as signed integers; the border's is 0 and unused."""
    own = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed)
    return np.fromiter((xxhash.xxh64_intdigest(w, own) for w in names), np.uint64, len(names)).view(np.int64)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two keys, for the bitmap of frequent pairs."""
    return a * np.int64(31) + b


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Is a key's bit set?  The number of bits is a power of two."""
    at = keys & np.int64(len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class Bitmaps:
    """Compressed position bitmaps of a shard's words: the bytes that are not empty."""

    def __init__(self, at: np.ndarray, n_words: int):
        spots = np.flatnonzero(at)
        key = (spots >> 3) * np.int64(n_words) + at[spots]
        order = np.argsort(key, kind="stable")
        key, bit = key[order], np.left_shift(np.uint8(1), (spots[order] & 7).astype(np.uint8))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        #: By byte: the words that have bits there, and these bits.
        self.byte, self.word = key[starts] // n_words, (key[starts] % n_words).astype(np.int64)
        self.bits = np.bitwise_or.reduceat(bit, starts) if len(starts) else np.zeros(0, np.uint8)
        self.first = np.searchsorted(self.byte, np.arange((len(at) >> 3) + 3))
        #: By word: the same entries.
        self.by_word = np.argsort(self.word, kind="stable")

    def batches(self, most: int = 150_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, byte, bits) of whole words, some `most` entries at a time."""
        word = self.word[self.by_word]
        at = 0
        while at < len(word):
            stop = at + most
            stop = len(word) if stop >= len(word) else int(np.searchsorted(word, word[stop], "left"))
            if stop <= at:  # one word alone has more
                stop = int(np.searchsorted(word, word[at], "right"))
            own = self.by_word[at:stop]
            yield self.word[own], self.byte[own], self.bits[own]
            at = stop

    def extended(self, owner: np.ndarray, byte: np.ndarray, bits: np.ndarray, n_words: int):
        """All one-word extensions of phrases: their (owner, word), counts, and bitmaps by number of extension."""
        over = bits >> 7  # the shift carries the highest bit into the next byte
        low = bits << 1
        owner, byte, bits = (np.concatenate((x[low > 0], y[over > 0])) for x, y in ((owner, owner), (byte, byte + 1), (low, over)))
        n = self.first[byte + 1] - self.first[byte]
        ends = np.cumsum(n)
        line = np.repeat(np.arange(len(byte)), n)
        entry = np.arange(len(line)) - np.repeat(ends - n, n) + np.repeat(self.first[byte], n)
        both = bits[line] & self.bits[entry]
        hit = np.flatnonzero(both)
        both, line, word = both[hit], line[hit], self.word[entry[hit]]
        key = owner[line] * np.int64(n_words) + word
        order = np.argsort(key, kind="stable")
        key, line, both = key[order], line[order], both[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        counts = np.add.reduceat(np.bitwise_count(both).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        number = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
        return key[starts] // n_words, key[starts] % n_words, counts, (number, byte[line], both)


def counted(at: np.ndarray, keys: np.ndarray, words: np.ndarray, pairs: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Keys and counts of the phrases of a shard: of pairs, or of triples of frequent pairs."""
    keep = has(words, keys)
    keep[0] = False  # the border
    number = np.zeros(len(keys), np.int64)
    number[keep] = np.arange(1, int(keep.sum()) + 1)
    own = np.r_[np.int64(0), keys[keep]]
    maps = Bitmaps(number[at], len(own))
    for owner, byte, bits in maps.batches():
        a, b, n, (phrase, byte, bits) = maps.extended(owner, byte, bits, len(own))
        if pairs is None:
            yield own[a], own[b], n
            continue
        frequent = has(pairs, pair_keys(own[a], own[b]))  # others are extended no further
        go = frequent[phrase]
        ab, c, n, _ = maps.extended(phrase[go], byte[go], bits[go], len(own))
        good = has(pairs, pair_keys(own[b[ab]], own[c]))
        ab, c, n = ab[good], c[good], n[good]
        yield own[a[ab]], own[b[ab]], own[c], n


def _pass(docs: DataFrame, out: str, each, shard_words: int) -> DataFrame:
    """each(positions, names, lang) of each shard of each task, as record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = shards.get(lang) or shards.setdefault(lang, Shard(lang))
                for words in words_of(text):
                    shard.add(words)
                    if shard.n > shard_words and BORDER in words:
                        yield from each(*shard.taken(False), lang)
                shard.close()
            if sum(s.n for s in shards.values()) > 4 * shard_words:  # many languages share the room
                for s in shards.values():
                    yield from each(*s.taken(True), s.lang)
                shards.clear()
        for s in shards.values():
            yield from each(*s.taken(True), s.lang)

    return docs.mapInArrow(run, out)


def _bitmap(keys: DataFrame, key: Column, log2_bits: int) -> np.ndarray:
    """A bit for each key's hash; a table of at most 2 ** log2_bits / 32768 rows, whatever the number of keys."""
    bit = F.pmod(key, F.lit(1 << log2_bits)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(1 << (log2_bits - 3), np.uint8)
    for r in rows:
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _slices(arrays: tuple, names: list[str], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(arrays[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(a[k : k + rows]) for a in arrays], names=names)


@dataclass(frozen=True)
class Counts:
    """words(key, lang, word, f) of all words; pairs(k1, k2, f) and triples(k1, k2, k3, f) of frequent phrases."""

    words: DataFrame
    pairs: DataFrame
    triples: DataFrame


def count(docs: DataFrame, least: int = 10, shard_words: int = 2_000_000, text_col: str = "text", lang_col: str = "lang", seed: int = 42, word_bits: int = 24, pair_bits: int = 28, width: int = 64) -> Counts:
    """Exact counts of all words, and of those phrases of two and three words that occur `least` times.  width: bits of a key (tests make them collide)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    while True:
        mask = np.int64(-1) if width == 64 else np.int64((1 << width) - 1)
        start = seed

        def names(at, words, lang, start=start, mask=mask):
            n = np.bincount(at, minlength=len(words))[1:]
            if len(words) > 1:
                yield from _slices((word_keys(lang, words, start)[1:] & mask, np.array([lang] * (len(words) - 1), object), np.array([w.decode("utf-8", "surrogatepass") for w in words[1:]], object), n), ["key", "lang", "word", "f"])

        rows = _pass(docs, "key long, lang string, word string, f long", names, shard_words)
        one = F.struct("lang", "word")
        sums = rows.groupBy("key").agg(F.min(one).alias("one"), F.max(one).alias("other"), F.sum("f").alias("f"))
        mark = scratch_mark()
        words = written(sums.select("key", "one.lang", "one.word", "f", (F.col("one") != F.col("other")).alias("shared")), "phrase-words")
        if words.where("shared").limit(1).count() == 0:
            break
        clean(spark, mark)
        seed, width = seed + 1, 64
    frequent = spark.sparkContext.broadcast(_bitmap(words.where(F.col("f") >= least), F.col("key"), word_bits))

    def two(at, words, lang, start=start, mask=mask):
        for arrays in counted(at, word_keys(lang, words, start) & mask, frequent.value, None):
            yield from _slices(arrays, ["k1", "k2", "f"])

    pairs = written(_pass(docs, "k1 long, k2 long, f long", two, shard_words).groupBy("k1", "k2").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrase-pairs")
    low = lambda k: F.pmod(F.col(k), F.lit(1 << pair_bits))  # noqa: E731  the bits of pair_keys that count
    both = spark.sparkContext.broadcast(_bitmap(pairs, low("k1") * 31 + low("k2"), pair_bits))

    def three(at, words, lang, start=start, mask=mask):
        for arrays in counted(at, word_keys(lang, words, start) & mask, frequent.value, both.value):
            yield from _slices(arrays, ["k1", "k2", "k3", "f"])

    triples = written(_pass(docs, "k1 long, k2 long, k3 long, f long", three, shard_words).groupBy("k1", "k2", "k3").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrase-triples")
    return Counts(words, pairs, triples)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly, for counts of up to 15 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    times = lambda x, y: (x * y).cast("decimal(38,0)")
    return F.call_function("div", times(times(wide(a), wide(a)), F.lit(1_000_000).cast("decimal(7,0)")), times(wide(left), wide(right))).cast("long")


def candidates(counts: Counts, least: int = 10, inside: int = 50) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that lie in no longer one that has `inside` percent of their occurrences."""
    words = counts.words.where(F.col("f") >= least)

    def named(rows: DataFrame, key: str, lang: bool = False) -> DataFrame:
        w = words.select(F.col("key").alias(key), F.col("word").alias("w" + key[1:]), F.col("f").alias("f" + key[1:]), *([F.col("lang")] if lang else []))
        return rows.join(w, key)

    covered = counts.triples.select(F.explode(F.array(F.struct("k1", "k2", "f"), F.struct(F.col("k2").alias("k1"), F.col("k3").alias("k2"), "f"))).alias("p")).groupBy("p.k1", "p.k2").agg(F.max("p.f").alias("longer"))
    pairs = counts.pairs.join(covered, ["k1", "k2"], "left").where(100 * F.coalesce("longer", F.lit(0)) < inside * F.col("f"))
    pairs = named(named(pairs, "k1", True), "k2")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), score(F.col("f"), F.col("f1"), F.col("f2")).alias("score"))
    heads = counts.pairs.select("k1", "k2", F.col("f").alias("f12"))
    tails = counts.pairs.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("f").alias("f23"))
    triples = counts.triples.join(heads, ["k1", "k2"]).join(tails, ["k2", "k3"])
    triples = named(named(named(triples, "k1", True), "k2"), "k3")
    first, second = score(F.col("f"), F.col("f1"), F.col("f23")), score(F.col("f"), F.col("f12"), F.col("f3"))
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), "f1", "f23", "f12", "f3", first.alias("s1"), second.alias("s2"))
    early = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(early, F.col(x)).otherwise(F.col(y))
    triples = triples.select("lang", "phrase", "a", pick("f1", "f12").alias("l"), pick("f23", "f3").alias("r"), pick("s1", "s2").alias("score"))
    return pairs.unionByName(triples)


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, inside: int = 50, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top`."""
    counts = count(docs, least, **options)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each of 64 parts of a language, then the first of these: no task sees more than 64 * top
    part = candidates(counts, least, inside).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = counts.words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
