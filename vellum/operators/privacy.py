"""Pseudonyms, stable codes, fingerprints, and the choice of what counts of a submission."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.kernels import lazy_udf

#: Particles of names that are no names by themselves (fixed values).
PARTICLES = frozenset("van de der den het ten ter te la le du des da dos el al von zu".split())


def name_tokens(names: list[str]) -> tuple[list[str], list[str]]:
    """(long, short) tokens of names, longest first: five letters or more match in any case, three or four exactly."""
    words = {w for n in names for w in re.findall(r"[^\W\d_]+", n) if len(w) >= 3 and w.lower() not in PARTICLES}
    key = lambda w: (-len(w), w)
    return sorted({w.lower() for w in words if len(w) >= 5}, key=key), sorted({w for w in words if len(w) < 5}, key=key)


def name_patterns(names: list[str]) -> list[str]:
    """Java patterns for the tokens; anything but a letter or digit is a border, an underscore too."""
    long, short = name_tokens(names)
    border = r"(?U)(?<![\p{IsAlphabetic}\p{IsDigit}])(?:%s)(?![\p{IsAlphabetic}\p{IsDigit}])"
    return [p for p in ("(?iu)" + border % "|".join(map(re.escape, long)) if long else "", border % "|".join(map(re.escape, short)) if short else "") if p]


def redacted(text: Column, patterns: list[str], by: str = "[naam]") -> tuple[Column, Column]:
    """(text without names, how many were replaced).  The name list, and so the pattern, is one group's: bounded."""
    n = F.lit(0)
    for p in patterns:
        n = n + F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))
        text = F.regexp_replace(text, p, by)
    return text, n


NAME = re.compile(r"[^\W\d_]+")  #: words of a name
RUN = re.compile(r"[^\W_]+")  #: letters and digits in a row; what is around them is a border


def _token(word: str) -> str | None:
    """What a word of a name or text is looked up as: five letters or more in any case, three or four as they are; None for what names nobody."""
    if len(word) < 3 or word.lower() in PARTICLES:
        return None
    return word.lower() if len(word) >= 5 else word


#: Spark's xxhash64 of a text is XXH64 with this seed.
SEED = 42


def _candidates(bits: np.ndarray | None):
    """mapInArrow body: (key, text) to (key, token) of the distinct words whose bit is set; without bits, of all words of names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = NAME if bits is None else RUN
        for batch in batches:
            keys, tokens, known = [], [], {}
            for i, text in enumerate(batch.column(1).to_pylist()):
                for w in set(pattern.findall(text or "")):
                    token = known.get(w, 0)
                    if token == 0:
                        token = _token(w)
                        if token is not None and bits is not None:
                            at = xxhash.xxh64_intdigest(token, SEED) & (len(bits) * 8 - 1)
                            token = token if bits[at >> 3] >> (at & 7) & 1 else None
                        known[w] = token
                    if token is not None:
                        keys.append(i)
                        tokens.append(token)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(tokens, pa.string())], names=["key", "token"])

    return run


def _replaced(by: str):
    def run(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, names, strict=True):
            found, n = frozenset(() if own is None else own), 0
            if text is None or not found:
                out.append((text, 0))
                continue

            def one(m, found=found):
                nonlocal n
                if _token(m[0]) in found:
                    n += 1
                    return by
                return m[0]

            out.append((RUN.sub(one, text), n))
        return pd.DataFrame(out, columns=["text", "n"])

    return lazy_udf(run, "struct<text:string,n:int>")


def redact_large(rows: DataFrame, names: DataFrame, text: str, name: str, key: str, by: str = "[naam]", log2_bits: int = 26) -> DataFrame:
    """As redacted, for a name table of any size: rows with redacted and n_names; key names a row.

    A bitmap of fixed size (8 MB) tells each task which words may be names; only these are
    joined with the names, and what is left of them, a few for each row, goes back to
    the texts, in which one pass replaces them.  A border is whatever is no letter or digit,
    and a word between two borders is whole, so the longest match is the word.  Texts
    are moved once, to meet their names.
    """
    spark = rows.sparkSession
    tokens = names.select(F.lit(0).alias("key"), F.col(name).cast("string").alias("name")).mapInArrow(_candidates(None), "key int, token string").select("token").distinct()
    at = F.pmod(F.xxhash64("token"), F.lit(1 << log2_bits)) + 1
    parts = tokens.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # at most 2 ** log2_bits / 32768 rows
    bits = np.zeros(1 << (log2_bits - 3), np.uint8)
    for r in parts:
        bits[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(bits)
    kind = rows.schema[key].dataType.simpleString()
    asked = rows.select(key, text).mapInArrow(lambda batches: _candidates(shared.value)(batches), f"key {kind}, token string")
    per = asked.join(tokens, "token").groupBy("key").agg(F.collect_set("token").alias("_names"))
    joined = rows.join(per.withColumnRenamed("key", "_key"), F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn("_r", _replaced(by)(F.col(text), F.col("_names"))).withColumn("redacted", F.col("_r.text")).withColumn("n_names", F.col("_r.n").cast("long")).drop("_r", "_names", "_key")


def stable_codes(ids: DataFrame, known: DataFrame, id: str, prefix: str = "S") -> DataFrame:
    """code, id: known codes kept, new ids numbered on from the largest in id order; three digits from 100 on, else two.

    Numbering needs one order over the new ids only; they are counted by range
    partition first, so no task sorts them all.
    """
    number = F.regexp_extract("code", r"(\d+)$", 1).cast("int")
    top = known.agg(F.max(number)).first()[0] or 0
    new = ids.select(id).distinct().join(known.select(id), id, "left_anti")
    ranked = global_rank(new, id).select(id, (F.col("rank") + top).alias("n"))
    width = 3 if top + new.count() >= 100 else 2
    coded = ranked.select(F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(width), F.length(F.col("n").cast("string"))), F.lit("0"))).alias("code"), id)
    return known.select("code", id).unionByName(coded)


def global_rank(rows: DataFrame, order: str) -> DataFrame:
    """rank (from 1) of rows by a distinct column: range partitions, their sizes summed up, row numbers within."""
    spread = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).persist()
    sizes = spread.groupBy("_part").count().orderBy("_part").collect()  # one row for each partition
    first, rows_before = {}, 0
    for r in sizes:
        first[r["_part"]] = rows_before
        rows_before += r["count"]
    starts = F.create_map(*[x for k, v in first.items() for x in (F.lit(k), F.lit(v))]) if first else F.expr("cast(map() as map<int,int>)")
    w = Window.partitionBy("_part").orderBy(order)
    return spread.withColumn("rank", F.row_number().over(w) + F.element_at(starts, F.col("_part"))).drop("_part")


def latest_per_kind(files: DataFrame, student: list[str], kind: str, submission: list, date: str) -> DataFrame:
    """All files of a kind of the latest submission that has the kind; of equal dates the later in the input."""
    subs = files.select(*student, kind, date, *submission).distinct()
    w = Window.partitionBy(*student, kind).orderBy(F.desc(date), *(F.desc(s) for s in submission))
    last = subs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return files.join(last, [*student, kind, date, *submission], "left_semi")


def without_copies(files: DataFrame, keys: list[str], order: list[str], content: str, name: str, stem: Column, ext: Column) -> DataFrame:
    """The first of equal contents, and no PDF beside a docx of the same stem."""
    w = Window.partitionBy(*keys, F.sha2(F.col(content), 256)).orderBy(*order)
    firsts = files.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    docx = firsts.where(ext == ".docx").select(*keys, stem.alias("_stem")).distinct()
    pdf = firsts.where(ext == ".pdf").withColumn("_stem", stem)
    return firsts.where(ext != ".pdf").unionByName(pdf.join(docx, [*keys, "_stem"], "left_anti").drop("_stem"))


def fingerprint(parts: DataFrame, keys: list[str], kind: str, content_hash: str, text: str | None = None) -> DataFrame:
    """keys, hash: SHA-256 over sorted lines kind:hash, then a line for each text; order of rows does not matter."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat(F.col(kind), F.lit(":"), F.col(content_hash), F.lit("\n")))), "")
    texts = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("tekst:"), F.col(text), F.lit("\n")))), "") if text else F.lit("")
    return parts.groupBy(*keys).agg(F.sha2(F.concat(lines, texts).cast("binary"), 256).alias("hash"))


def item_hash(xml: Column, images: Column) -> Column:
    """Ten hex digits of SHA-1 over the item and its images' bytes in sorted order."""
    return F.substring(F.sha1(F.aggregate(F.array_sort(images), xml.cast("binary"), lambda a, x: F.concat(a, x))), 1, 10)


def is_empty_template(lines: Column, template: Column, n_images: Column) -> Column:
    """Whether all lines of a report are lines of its template, and it has no image of its own."""
    return (F.size(F.array_except(lines, template)) == 0) & (n_images == 0)


def text_lines(text: Column) -> Column:
    """Distinct lines with white space folded, blank ones left out."""
    folded = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_distinct(F.filter(folded, lambda x: x != ""))


def _roots(stems: pd.Series) -> pd.Series:
    from vellum.functions.kernels import chain_root

    known = {x: chain_root(x) for x in stems.dropna().unique()}
    return stems.map(known.get)


chain_root_udf = lazy_udf(_roots, "string")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (kind, sha1, root, ext, stem, shown), sorted, to (kind, sha1, name_stem, name_no, name_ext)."""
    from vellum.functions.kernels import Numbers

    group = numbers = None
    for batch in batches:
        stems, nos = [], []
        for *now, stem in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            if numbers is None or now != group:
                group, numbers = now, Numbers()
            own, no = (None, None) if stem is None else numbers.name(stem)
            stems.append(own)
            nos.append(no)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(stems, pa.string()), pa.array(nos, pa.int64()), batch.column(5)], names=["_kind", "_sha1", "name_stem", "name_no", "name_ext"])


def stage_assets(assets: DataFrame, kind: str, content: str, wanted: str, order: list[str], length: int = 80) -> DataFrame:
    """assets with sha1, name and reused: equal contents of a kind share the first one's name; names collide cumulatively.

    The n-th of one wish is x-2-3-...-n, so n such names have some n * n letters.  They
    are settled as (name_stem, name_no, name_ext), one triple for each name, wish by wish
    in the order of the sort, and `name` is put together only where it is read.
    """
    hashed = assets.withColumn("sha1", F.sha1(F.col(content)))
    w = Window.partitionBy(kind, "sha1").orderBy(*order)
    marked = hashed.withColumn("reused", F.row_number().over(w) > 1)
    cut, dot = F.substring(F.regexp_replace(wanted, r"\.[^.]*$", ""), 1, length), F.regexp_extract(wanted, r"(\.[^.]*)$", 1)
    stem, ext = F.when(cut == "", dot).otherwise(cut), F.when(cut == "", "").otherwise(dot)  # .x has no extension
    firsts = marked.where(~F.col("reused")).select(F.col(kind).alias("_kind"), F.col("sha1").alias("_sha1"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), stem.alias("_stem"), ext.alias("_ext"))
    group = ["_kind", "_root", "_low"]
    wishes = firsts.withColumn("_root", chain_root_udf(F.lower("_stem"))).withColumn("_low", F.lower("_ext"))
    dealt = wishes.repartition(*group).sortWithinPartitions(*group, *(f"_o{i}" for i in range(len(order))), "_sha1").select("_kind", "_sha1", "_root", "_low", "_stem", "_ext")
    named = dealt.mapInArrow(_numbered, f"_kind {assets.schema[kind].dataType.simpleString()}, _sha1 string, name_stem string, name_no long, name_ext string")
    name = F.concat("name_stem", F.when(F.col("name_no") > 1, F.concat(F.lit("-"), F.array_join(F.sequence(F.lit(2), F.col("name_no")), "-"))).otherwise(""), "name_ext")
    return marked.join(named, F.col(kind).eqNullSafe(F.col("_kind")) & F.col("sha1").eqNullSafe(F.col("_sha1")), "left").withColumn("name", name).drop("_kind", "_sha1")
