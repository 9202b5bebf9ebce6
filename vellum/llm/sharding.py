"""Sharding by vector bin packing.

Groups of equal texts stay together where they fit.  A group is a vector (bytes,
tokens, rows); it goes to the shard where the dot product of its vector with the
shard's residual capacity is highest.  Law of the assignment: `bytes`.

Scale.  The number of groups is not bounded, so the packer never sees them one by one:

* a group heavier than `heavy_share` of a shard in some dimension is placed on its
  own, and one heavier than `cut_share` is cut into pieces of about half that, dealt
  by a hash of doc_id (a group of copies that holds a third of all rows becomes many
  pieces); there are at most 3 * shards / heavy_share of them, whatever the input;
* lighter groups are bundled by (size class, hash of the text), in a class into
  `bundles` bundles, or more where there are over `bundle_rows` rows for each, but at
  most `most_bundles`; some ten classes hold most texts of a corpus.

Only those bounded totals reach the driver.  Slots are offsets of bundles within
their shard plus a row number within a bundle, so no window holds a whole shard.

Nulls: a null doc_id is an id like any other; a null text counts no bytes and forms a group of its own, apart from the
empty text.  Rows that repeat (equal doc_id and text) each get a slot.  An empty
table gives an empty result.  Dot products that agree to nine decimals tie; the lower shard gets the
group.  A text of any
length is one row, and alone in its group it is placed whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import checkpointed, n_words

SHARDS = 40
#: What one row costs beside its text, in bytes.
ROW_BYTES = 16


def pack(weights: np.ndarray, shards: int, importance=(8.0, 1.0, 2.0)) -> np.ndarray:
    """The shard of each item.  weights: items x (bytes, tokens, rows).

    Items are placed heaviest first.  Weights and residuals are in units of an even
    share; `importance` scales the dimensions in the dot product (bytes is the law).
    """
    n = len(weights)
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    even = weights.sum(0) / shards
    w = weights / np.where(even > 0, even, 1.0)
    imp = np.asarray(importance, dtype=float)
    left = np.ones((shards, w.shape[1]))
    order = np.lexsort((np.arange(n), -w.max(1)))
    for i in order:
        # a shard that is over in a dimension has a negative residual there, which counts against it
        k = int(np.argmax(np.round((left * (imp * w[i])).sum(1), 9)))
        out[i] = k
        left[k] -= w[i]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, heavy_share: float = 1 / 64, cut_share: float = 0.5, bundles: int = 256, bundle_rows: int = 50_000, most_bundles: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    shards: how many; heavy_share, cut_share: as shares of a shard;
    bundles, bundle_rows, most_bundles: hash bundles for each size class.  Other columns of docs are not read,
    whatever they are called.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        n_words(text).alias("words"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"), F.length(text).alias("n")).alias("grp"),
    )
    rows = checkpointed(rows)
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.sum("words").alias("tokens"), F.count("*").alias("n"))
    groups = checkpointed(groups)
    total = groups.agg(F.sum("bytes"), F.sum("tokens"), F.sum("n")).first()
    bundles = max(bundles, min(most_bundles, -(-(total[2] or 0) // bundle_rows)))
    even = [max(1.0, (x or 0) / shards) for x in total]
    share = F.greatest(F.col("bytes") / even[0], F.col("tokens") / even[1], F.col("n") / even[2])
    # the heavy groups number at most 3 * shards / heavy_share, so they may be broadcast
    heavy = groups.select("grp", F.when(share > cut_share, F.ceil(share / (cut_share / 2))).otherwise(F.lit(1)).cast("long").alias("pieces"), share.alias("share")).where(F.col("share") > heavy_share).select("grp", "pieces")
    unit = (
        rows.join(F.broadcast(heavy), rows["grp"].eqNullSafe(heavy["grp"]), "left")
        .select("doc_id", "size", "words", "text_crc32", rows["grp"].alias("grp"), "pieces")
        .withColumn("unit", F.when(F.col("pieces").isNotNull(), F.xxhash64("grp", F.pmod(F.xxhash64("doc_id"), F.col("pieces")))))
    )
    # a light group's class is the log of its own size, so bundles of a class weigh alike
    unit = unit.withColumn("unit", F.coalesce("unit", F.xxhash64(F.floor(F.log2(F.col("size").cast("double"))), F.pmod(F.xxhash64("grp"), F.lit(bundles)))))
    totals = unit.groupBy("unit").agg(F.sum("size").alias("bytes"), F.sum("words").alias("tokens"), F.count("*").alias("n")).orderBy("unit").toPandas()
    at = pack(totals[["bytes", "tokens", "n"]].to_numpy(dtype=float).reshape(-1, 3), shards)
    totals["shard"] = at
    totals["first"] = totals.groupby("shard")["n"].cumsum() - totals["n"]
    placed = spark.createDataFrame(list(zip(totals["unit"].tolist(), totals["shard"].tolist(), totals["first"].tolist(), strict=True)), "unit long, shard int, first long")
    slots = unit.join(F.broadcast(placed), "unit").withColumn("rn", F.row_number().over(Window.partitionBy("unit").orderBy("doc_id", "text_crc32", "size")))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
