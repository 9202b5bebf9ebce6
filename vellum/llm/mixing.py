"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
150 % of all words; no target exceeds twice its source, and the excess is shared
again by weight until none does.

The words of a source are laid out in a seeded order and cut into blocks of
`block_words`; the blocks of all sources are apportioned to the targets by highest
quotients target / (2 k + 1), then each source's quota is apportioned to its shards
in the same way.  A shard takes each of its blocks quota // blocks times and a
seeded choice of them once more, so no word is taken more than twice.

Scale.  A source's rows are dealt over shards of about `shard_words` words and at most
`shard_rows` rows by a hash of doc_id (of the text where it is null), so a source with a
third of all rows is many bounded windows.  There are about `most_shards` shards at
most, one row each for the driver; beyond that shards grow with the input.

Rows without id and of one text are one window.  Nulls and empty texts have size 0 and take 0.  A null source is a source of its own,
the last.  Rows that repeat are separate rows.  Equal seeded hashes are ordered by
doc_id, size and text.  A text of any length is a run of blocks like any other.  An empty
table gives an empty result.  Only the id, the text and the source are read by `mix`;
`apply_mix` carries all other columns along, whatever they are called.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import checkpointed, n_words

WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights: list[float], budget: float, cap: float = 2.0) -> list[float]:
    """Shares of budget by weight, none above cap times its size; the excess goes to the others."""
    n, out = len(sizes), [0.0] * len(sizes)
    open_, left = [i for i in range(n) if sizes[i] > 0], min(budget, cap * sum(sizes))
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1), at most most[i] for i; ties go to the earlier.

    A bisection over the lowest winning quotient replaces dealing out seat by seat.
    """
    v, cap = np.asarray(votes, dtype=float), np.asarray(most, dtype=np.int64)
    seats = int(min(seats, cap[v > 0].sum())) if len(v) else 0
    if seats <= 0:
        return [0] * len(votes)

    def won(q: float) -> np.ndarray:
        """Seats with a quotient of q at least: (2 k + 1) <= v / q."""
        return np.where(v > 0, np.minimum(np.floor((v / q + 1) / 2).astype(np.int64), cap), 0)

    lo, hi = v.max() / (4.0 * (int(cap.max()) + seats) + 8), v.max() * 2
    lo = min(lo, v[v > 0].min() / (2.0 * int(cap.max()) + 3))
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        if mid <= lo or mid >= hi:
            break
        lo, hi = (mid, hi) if won(mid).sum() >= seats else (lo, mid)
    got = won(hi)
    rest = seats - int(got.sum())
    while rest > 0:  # the quotients that tie at the boundary
        q = np.where((got < cap) & (v > 0), v / (2 * got + 1), -1.0)
        k = int(np.argmax(q))
        got[k] += 1
        rest -= 1
    return got.tolist()


def mix(docs: DataFrame, budget_share: float = 1.5, weights=WEIGHTS, cap: float = 2.0, block_words: int = 50, shard_words: int = 1_000_000, shard_rows: int = 100_000, most_shards: int = 100_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (and source and text_key) for each row of docs.

    block_words bounds the rounding of a source's quota; shard_words, shard_rows and most_shards the rows of one window.
    """
    spark = docs.sparkSession
    name = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col), F.lit(seed))).otherwise(F.xxhash64(F.col(id_col), F.lit(seed)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), name.alias("dealt"), text_key(F.col(text_col)).alias("text_key"))
    rows = checkpointed(rows)
    sums = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    found = {r["source"]: (r["words"], r["n"]) for r in sums}
    names = sorted(k for k in found if k is not None) + ([None] if None in found else [])  # Python orders by code point
    sizes = [found[k][0] for k in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], budget_share * sum(sizes), cap)
    words_each, rows_each = max(shard_words, sum(sizes) / most_shards), max(shard_rows, sum(n for _, n in found.values()) / most_shards)
    plan = spark.createDataFrame([(k, s, g, max(1, math.ceil(s / words_each), math.ceil(found[k][1] / rows_each))) for k, s, g in zip(names, sizes, goal, strict=True)], "source string, source_size long, target double, n_shards long")
    # one row for each source: the number of distinct sources, checked before it is broadcast
    plan = F.broadcast(plan) if len(names) <= 100_000 else plan
    laid = rows.join(plan, rows["source"].eqNullSafe(plan["source"]), "left").select("doc_id", "text_key", rows["source"].alias("source"), "size", "source_size", "target", F.pmod("dealt", "n_shards").alias("shard"), F.xxhash64(F.lit(seed + 1), "dealt").alias("h"))
    per_shard = laid.groupBy("source", "shard").agg(F.sum("size").alias("words")).collect()
    part = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size", "text_key")
    laid = laid.withColumn("end", F.sum("size").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    shards: dict = {k: [] for k in names}
    for r in per_shard:
        shards[r["source"]].append((r["shard"], r["words"]))
    blocks = {k: [(j, w, w // block_words + (w % block_words > 0)) for j, w in sorted(v)] for k, v in shards.items()}
    most = [int(cap * sum(b for _, _, b in blocks[k])) for k in names]
    seats = round(sum(goal) / block_words)
    quota = sainte_lague(goal, seats, most)
    dealt = [(k, j, q // b, q % b, b) for k, n in zip(names, quota, strict=True) for (j, _, b), q in zip(blocks[k], sainte_lague([w for _, w, _ in blocks[k]], n, [int(cap * b) for _, _, b in blocks[k]]), strict=True) if b]
    quotas = spark.createDataFrame(dealt or [(None, 0, 0, 0, 1)], "q_source string, q_shard long, whole long, more long, n_blocks long")
    joined = laid.join(F.broadcast(quotas) if len(dealt) <= 200_000 else quotas, laid["source"].eqNullSafe(quotas["q_source"]) & (laid["shard"] == quotas["q_shard"]), "left")
    # the seeded choice of `more` blocks out of n: the first `more` after a seeded rotation, spread evenly:
    # block b is chosen if floor((b + r + 1) * more / n) > floor((b + r) * more / n); counting those below x is closed
    r = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("source"), F.col("shard")), F.col("n_blocks"))

    def chosen_words(x):
        """Words before offset x of the shard that lie in chosen blocks."""
        b = F.floor(x / block_words)
        upto = lambda k: F.floor((k + r) * F.col("more") / F.col("n_blocks"))
        inside = F.when(upto(b + 1) > upto(b), x - b * block_words).otherwise(F.lit(0))
        return (upto(b) - upto(F.lit(0))) * block_words + inside

    first = F.col("end") - F.col("size")
    taken = F.col("size") * F.col("whole") + chosen_words(F.col("end")) - chosen_words(first)
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), "source", "text_key")


def text_key(text: Column) -> Column:
    """Tells texts apart; with the id and the source, rows that are the same."""
    return F.xxhash64(F.lit(7), F.coalesce(text, F.lit("")))


def apply_mix(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them.

    A row is taken taken / size times, rounded up or down by a seeded hash of its id and
    text so that sources keep their targets: 0, 1 or 2 times.  Rows of equal id, source
    and text, and only these, share one draw: their copies are summed up, rounded once and
    dealt out over them evenly.  Rows without id are told apart by their texts.  A text
    without words costs nothing and stays once.
    """
    got = mix(docs, seed=seed, **options).groupBy("doc_id", "source", "text_key").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("n"))
    u = F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed + 3)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.when(F.col("size") == 0, F.col("n")).otherwise(F.floor(F.col("taken") * F.col("n") / F.col("size") + u))
    plan = got.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("text_key").alias("p_key"), copies.cast("long").alias("p_copies"), F.col("n").alias("p_n")).where("p_copies > 0")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text", "source")}
    whole = docs.toDF(*names)
    plain = [n for n, f in zip(names, docs.schema.fields, strict=True) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    joined = whole.join(plan, at["doc_id"].eqNullSafe(F.col("p_id")) & at["source"].cast("string").eqNullSafe(F.col("p_source")) & (text_key(at["text"]) == F.col("p_key")))
    nth = F.row_number().over(Window.partitionBy("p_id", "p_source", "p_key").orderBy(F.xxhash64(*plain)))
    times = F.floor(F.col("p_copies") / F.col("p_n")) + (nth <= F.col("p_copies") % F.col("p_n")).cast("int")
    copies = joined.withColumn("p_times", F.when(F.col("p_n") == 1, F.col("p_copies")).otherwise(times).cast("int")).withColumn("p_copy", F.explode(F.array_repeat(F.lit(0), F.col("p_times"))))
    return copies.select(*names).toDF(*docs.columns)
