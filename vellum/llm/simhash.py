"""Near duplicates by SimHash, searched with a generalised pigeonhole.

A fingerprint has 64 bits: bit i is set if it is set in over half of the XXH64 hashes
(seed 42) of a text's four-word shingles.  Fingerprints link at `distance` or fewer
differing bits; documents of linked fingerprints, transitively, are a component.

Search.  The 64 bits are grouped into partitions, correlated bits together.  If
thresholds e_i >= -1 have sum(e_i + 1) = distance + 1, two linked fingerprints differ
in at most e_i bits of some partition i (else they would differ in distance + 1 bits).
Bit statistics over all distinct fingerprints tell which bits go together; the
distances of all of them to a seeded set of `references` fingerprints, partition by
partition, estimate how many candidates each partition yields for each threshold.
Dynamic programming allots unequal thresholds, and the number of partitions, for the
least probes plus candidates; the choice changes the work, never the links.  Then each
fingerprint is filed under its bits in partition i and probes all keys within e_i
bits; candidates that share a key are verified.

Scale.  Copies are one fingerprint from the start.  Keys are dealt over many tasks by
hash; a key that over `hot` rows come to, filed there or probing it from near keys, is
cut into a grid of cells, filed rows across and looking rows down, of about `hot` of each,
so no key's group is ever one task's.  A task verifies in numpy, in bounded
steps, and emits a spanning forest of its links rather than the links: at most one
row for each fingerprint it read.  No link between different fingerprints is lost
for the components.  Nothing but bit statistics and counts reaches the driver.

A null text, or one without words, has fingerprint zero and links like any other.
Fewer than four words are one shingle; a text of any length is hashed in steps.  A bit
set in exactly half of the hashes is 0.  Rows that repeat share a component.  Rows with
one doc_id and different texts are judged by their texts.  A row without doc_id names
no component.  An empty table gives an empty result.  Only the id and the text are
read, whatever other columns are called; `keep_one` carries them along.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import checkpointed, small_batches, utf8, written
from vellum.llm.graph import components

DISTANCE = 4
SHINGLE = 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = utf8(text).lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = len(words) - shingle + 1
    first = [0, *ends[: n - 1].tolist()]
    last = (ends[shingle - 1 :] - 1).tolist()
    counts, step = np.zeros(64, dtype=np.int64), 65_536
    for k in range(0, n, step):
        h = np.array([hashed(line[a:b], 42) for a, b in zip(first[k : k + step], last[k : k + step], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def fingerprinted(rows: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """rows with the text's fingerprint as last column, own_fp."""
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], names=[*batch.schema.names, "own_fp"])

    return rows.mapInArrow(run, rows.select("*", F.lit(0).cast("long").alias("own_fp")).schema)


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often bits i and j are both set, in a task's fingerprints."""
    total = np.zeros((64, 64))
    for batch in batches:
        raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
        total += (bits.T @ bits).astype(float)
    i, j = np.triu_indices(64)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "n"])


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """The bits dealt to parts of nearly equal size, each grown by the bit most correlated with it."""
    free, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        pool = sorted(free)
        sub = np.abs(corr[np.ix_(pool, pool)])
        np.fill_diagonal(sub, 0)
        own = [pool[int(sub.max(1).argmax())]] if size else []
        free -= set(own)
        while len(own) < size:
            pool = sorted(free)
            own.append(pool[int(np.abs(corr[np.ix_(pool, own)]).mean(1).argmax())])
            free.discard(own[-1])
        out.append(sorted(own))
    return out


def groupings(corr: np.ndarray, distance: int = DISTANCE) -> list[list[list[int]]]:
    """The bits in one partition, in two, and so on."""
    return [group_bits(corr, parts) for parts in range(1, distance + 2)]


def independent(differ: np.ndarray, bits: list[int], distance: int = DISTANCE) -> np.ndarray:
    """Chance that a pair differs in at most 0, 1, ... of these bits, if each differs on its own."""
    p = np.zeros(distance + 1)
    p[0] = 1.0
    for q in differ[bits]:
        p[1:] = p[1:] * (1 - q) + p[:-1] * q
        p[0] *= 1 - q
    return p.cumsum()


#: What a verified candidate costs, in rows that are filed or probe.
CANDIDATE = 0.02


def allot(n: int, options: list[list[list[int]]], near: list[list[np.ndarray]], distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, from the groupings and each group's chances that a pair is within 0, 1, ... bits."""
    best: tuple[float, list] = (float("inf"), [])
    for groups, chances in zip(options, near, strict=True):
        table = {0: (0.0, ())}
        for g, p in zip(groups, chances, strict=True):
            ball = np.cumsum([float(math.comb(len(g), e)) for e in range(distance + 1)])
            # place e + 1 is threshold e; beyond 0 a pair is found from both its sides
            cost = [0.0, *(n * ball[e] + n * (e > 0) + CANDIDATE * n * n / 2 * p[e] * (1 if e == 0 else 2) for e in range(distance + 1))]
            after: dict[int, tuple[float, tuple]] = {}
            for used, (spent, es) in table.items():
                for x in range(distance + 2 - used):
                    if (found := spent + cost[x]) < after.get(used + x, (float("inf"), ()))[0]:
                        after[used + x] = (found, (*es, x - 1))
            table = after
        spent, es = table[distance + 1]
        if spent < best[0]:
            best = (spent, [(g, e) for g, e in zip(groups, es, strict=True) if e >= 0])
    return best[1]


def _near_counts(references: np.ndarray, options: list[list[list[int]]], distance: int):
    """mapInArrow body: fp to how often it is within 0, 1, ... bits of a reference, in each group of each grouping."""
    masks = [(k, j, np.uint64(sum(1 << b for b in g))) for k, groups in enumerate(options) for j, g in enumerate(groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(masks), distance + 1))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for start in range(0, len(fp), 10_000):
                x = fp[start : start + 10_000, None] ^ references[None, :]
                x = x[x != 0]  # not a fingerprint with itself
                for i, (_, _, mask) in enumerate(masks):
                    total[i] += np.bincount(np.minimum(np.bitwise_count(x & mask), distance + 1), minlength=distance + 2)[: distance + 1]
        rows = [(k, j, e, total[i, e]) for i, (k, j, _) in enumerate(masks) for e in range(distance + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), pa.int32(), pa.float64()], strict=True)], names=["k", "j", "e", "n"])

    return run


def plan(reps: DataFrame, n: int, distance: int = DISTANCE, references: int = 128, seed: int = 42) -> list[tuple[list[int], int]]:
    """Partitions and thresholds for the n fingerprints of reps."""
    stats = reps.select("fp").mapInArrow(_bit_counts, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 2080 rows
    both = np.zeros((64, 64))
    for r in stats:
        both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    share = both.diagonal() / max(1, n)
    cov = both / max(1, n) - np.outer(share, share)
    dev = np.sqrt(np.maximum(cov.diagonal(), 1e-12))
    options = groupings(cov / np.outer(dev, dev), distance)
    refs = np.array([r["fp"] for r in reps.select("fp").orderBy(F.xxhash64("fp", F.lit(seed)), "fp").limit(references).collect()], dtype=np.int64).view(np.uint64)
    counts = [[np.zeros(distance + 1) for _ in groups] for groups in options]
    for r in reps.select("fp").mapInArrow(_near_counts(refs, options, distance), "k int, j int, e int, n double").groupBy("k", "j", "e").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]][r["j"]][r["e"]] = r["n"]
    pairs = max(1, n * len(refs) - len(refs))
    differ = 2 * share * (1 - share)
    # where hardly any pair was that near, the single bits tell more
    near = [[np.where((c := counts[k][j].cumsum()) >= 10, c / pairs, np.maximum(independent(differ, g, distance), c / pairs)) for j, g in enumerate(groups)] for k, groups in enumerate(options)]
    return allot(n, options, near, distance)


def _extract(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, side by side."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


#: What a row is to its key: it looks at the filed rows behind it, is only looked at, or looks at all filed rows.
FILED, TARGET, PROBE = 0, 1, 2


def _flips(bits: int, e: int) -> list[int]:
    """Nothing, and all changes of one to e of so many bits."""
    return [0] + [sum(1 << b for b in c) for k in range(1, e + 1) for c in itertools.combinations(range(bits), k)]


def _loads(plan: list[tuple[list[int], int]]):
    """mapInArrow body: heavy (key, n) to the keys that their rows go to, as filed rows and as probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for part, (bits, e) in enumerate(plan):
                shift = 3 if len(bits) < 61 else 0
                own = np.flatnonzero((key & 7) == part) if shift else np.arange(len(key))
                for f in _flips(len(bits), e):
                    to = (key[own].view(np.uint64) ^ np.uint64(f << shift)).view(np.int64)
                    zero = np.zeros(len(own), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(zero if f else n[own]), pa.array(n[own] if f else zero)], names=["key", "filed", "probes"])

    return run


def _filed(plan: list[tuple[list[int], int]], distance: int):
    """mapInArrow body: fp, rep to rows (key, fp, rep, role); the key holds the partition in its low three bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rep = batch.column(1)
            for part, (bits, e) in enumerate(plan):
                own = _extract(fp, bits)
                for f in _flips(len(bits), e):
                    key = ((own ^ np.uint64(f)) * np.uint64(8) + np.uint64(part)) if len(bits) < 61 else (own ^ np.uint64(f))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), rep, pa.array(np.full(len(fp), PROBE if f else FILED, np.int32))], names=["key", "fp", "rep", "role"])

    return run


class Forest:
    """Labels of a task's nodes under links that come in steps."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:  # until each label is a root
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def verify(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, role: np.ndarray, distance: int, step: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of rep, of the links between rows that share a key."""
    order = np.lexsort((role, key))
    key, fp, rep, role = key[order], fp[order], rep[order], role[order]
    probe = role == PROBE
    reps, node = np.unique(rep, return_inverse=True)
    forest = Forest(len(reps))
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    end = np.r_[start[1:], len(key)].astype(np.int64) if len(key) else start
    filed = end - start - (np.add.reduceat(probe.astype(np.int64), start) if len(start) else 0)
    # each row looks at the filed rows of its key: at those after it if it is filed itself, at all if it probes
    group = np.repeat(np.arange(len(start)), end - start)
    row = np.arange(len(key))
    first = np.where(probe, start[group], row + 1)
    many = np.where(role == TARGET, 0, np.maximum(start[group] + filed[group] - first, 0))
    busy = np.flatnonzero(many)
    cum = np.cumsum(many[busy])
    at = 0
    while at < len(busy):
        upto = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + step, side="right")))
        rows = busy[at:upto]
        m = many[rows]
        left = np.repeat(rows, m)
        right = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[rows], m)
        good = np.bitwise_count(fp[left] ^ fp[right]) <= distance
        forest.add(node[left[good]], node[right[good]])
        at = upto
    moved = np.flatnonzero(forest.label != np.arange(len(reps)))
    return reps[moved], reps[forest.label[moved]]


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if cols:
            key, fp, rep, role = (np.concatenate(c) for c in zip(*cols, strict=True))
            a, b = verify(key, fp.astype(np.int64).view(np.uint64), rep, role, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def link_forest(reps: DataFrame, distance: int = DISTANCE, hot: int = 20_000, rows_per_task: int = 400_000) -> DataFrame:
    """Links (a, b) between rep of reps(fp, rep), enough to join what the fingerprints link."""
    spark = reps.sparkSession
    n = reps.count()
    found = plan(reps, n, distance)
    rows = "key long, fp long, rep long, role int"
    filed = reps.select("fp", "rep").mapInArrow(_filed(found, distance), rows)
    per = sum(len(_flips(len(g), e)) for g, e in found)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * per // rows_per_task))
    # a key is crowded by what is filed there and by what probes it from near keys: of keys with over hot / per rows
    # all neighbours are counted; what lighter ones add to a key is less than hot
    exact = reps.select("fp", "rep").mapInArrow(_filed([(g, 0) for g, _ in found], distance), rows).groupBy("key").agg(F.count("*").alias("n"))
    load = exact.where(F.col("n") > max(1, hot // per)).mapInArrow(_loads(found), "key long, filed long, probes long").groupBy("key").agg(F.sum("filed").alias("filed"), F.sum("probes").alias("probes"))
    cells = lambda c: F.greatest(F.lit(1), F.ceil(c / hot)).cast("int")
    looking = F.col("probes") + F.when(F.col("filed") > hot, F.col("filed")).otherwise(0)  # filed rows of one column look at the others
    crowded = load.where(F.col("filed") + F.col("probes") > hot).select(F.col("key").alias("hot_key"), cells(F.col("filed")).alias("across"), cells(looking).alias("down"))
    crowded = written(crowded, "simhash-hot")
    if not crowded.isEmpty():
        cut = filed.join(crowded, F.col("key") == F.col("hot_key"), "left")
        # cells in a grid: filed rows are dealt across, probing rows down.  A filed row is a target all down its
        # column, looks at its column once, and probes the other columns in the row it is dealt to
        x, y = (F.pmod(F.xxhash64("fp", F.lit(k)), F.col(c)).cast("int") for k, c in enumerate(("across", "down")))
        place = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
        columns, lines = F.sequence(F.lit(0), F.col("across") - 1), F.sequence(F.lit(0), F.col("down") - 1)
        as_probe = lambda i: place(i, y, F.lit(PROBE))
        own = F.transform(lines, lambda j: place(x, j, F.when(j == 0, FILED).otherwise(TARGET)))
        others = F.transform(F.filter(columns, lambda i: i != x), as_probe)
        places = F.when(F.col("across").isNull(), F.array(place(F.lit(0), F.lit(0), F.col("role")))).when(F.col("role") == PROBE, F.transform(columns, as_probe)).otherwise(F.concat(own, others))
        cut = cut.withColumn("place", F.explode(places))
        filed = cut.select(F.when(F.col("across").isNull(), F.col("key")).otherwise(F.xxhash64("key", "place.i", "place.j")).alias("key"), "fp", "rep", F.col("place.role").alias("role"))
    return filed.repartition(int(tasks), "key").mapInArrow(_links(distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of the component) for each row."""
    return _grouped(docs, distance, shingle, id_col, text_col).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, distance: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates with the component's smallest fingerprint as head."""
    prints = written(fingerprints(docs, shingle, id_col, text_col), "simhash")
    reps = written(prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-reps")
    named = components(link_forest(reps.select("fp", F.col("fp").alias("rep")), distance))
    of = reps.join(named, reps["fp"] == named["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("head"))
    of = checkpointed(of)
    least = of.where("fp <> head").groupBy(F.col("head").alias("h")).agg(F.min("least").alias("other"))  # one row for each component of several
    of = of.join(least, of["head"] == least["h"], "left").select(F.col("fp").alias("of_fp"), "head", "least", "other")
    first = of.where("of_fp = head").select(F.col("head").alias("k"), F.least("least", "other").alias("component_id"))
    heads = of.join(first, of["head"] == first["k"]).select("of_fp", "head", "component_id")
    return prints.join(heads, prints["fp"] == heads["of_fp"], "left").select("doc_id", "fp", "head", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, of which one document of each component is left, the one with the smallest doc_id.

    Of rows with that id and different texts, the one with the smaller fingerprint; of
    rows with that id and text, one.  A row without doc_id is in no component and stays.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rows = docs.toDF(*names)
    found = _grouped(rows, distance, shingle, own, text).where("doc_id = component_id")
    # smallest doc_id first, so a component has one row here unless that id has several texts
    first = found.groupBy("head").agg(F.min(F.struct("doc_id", "fp")).alias("first")).select("first.*")
    several = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    several = written(several, "simhash-repeated")
    single = first.join(several, first["doc_id"] == several["id"], "left_anti").select(F.col("doc_id").alias("id"))
    kept = rows.where(F.col(own).isNotNull()).join(single, F.col(own) == F.col("id"), "left_semi")
    if several.isEmpty():
        return kept.unionByName(rows.where(F.col(own).isNull())).toDF(*docs.columns)
    # rows whose id repeats are told apart by their fingerprint, which only they compute again
    again = rows.join(several, F.col(own) == F.col("id"), "left_semi")
    marked = fingerprinted(again, shingle, text)
    chosen = marked.join(first, (F.col(own) == F.col("doc_id")) & (F.col("own_fp") == F.col("fp")), "left_semi").dropDuplicates([own, "own_fp"]).select(*names)
    return kept.unionByName(chosen).unionByName(rows.where(F.col(own).isNull())).toDF(*docs.columns)
