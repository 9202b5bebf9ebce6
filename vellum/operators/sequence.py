"""Order-dependent operators: carry forward, as-of, ranges, islands, numbering, firsts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, own_row: bool = True) -> DataFrame:
    """The last non-null value up to each row of its key; own_row: whether a row's own value counts."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own_row else -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def nested_headings(rows: DataFrame, keys: list[str], order: list[str], outer: Column, inner: Column) -> DataFrame:
    """Nearest outer and inner heading above each row; an outer heading ends the inner one before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("outer_no", F.sum(outer.isNotNull().cast("int")).over(w)).withColumn("outer_heading", F.last(outer, ignorenulls=True).over(w))
    w2 = Window.partitionBy(*keys, "outer_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("inner_heading", F.last(inner, ignorenulls=True).over(w2)).drop("outer_no")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the latest right row that starts at or before it, null without one.

    Both sides are laid on one axis and carried forward: one shuffle and one sort, no
    range join.  Of right rows that start together the largest columns win.
    """
    lk = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_r"))
    rk = right.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*columns).alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    return lk.unionByName(rk).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").select("_l.*", *(F.col(f"_r.{c}").alias(c) for c in columns))


def in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points joined with the closed integer ranges that hold them.

    Ranges are dealt over cells of `width`; point and range meet by equality on key and
    cell, then the bounds are checked.  A point meets a range once, in its own cell.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    r = ranges.withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    p = points.withColumn("_cell", cell(at))
    return p.join(r, [*keys, "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_cell")


def islands(rows: DataFrame, keys: list[str], order: list[str], same: list[str], joined: dict[str, Column]) -> DataFrame:
    """Adjacent rows of equal `same` columns as one row: keys, island, same, and the aggregates in joined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce(~F.struct(*same).eqNullSafe(F.lag(F.struct(*same)).over(w)), F.lit(True)).cast("int")
    marked = rows.withColumn("island", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island", *same).agg(*(c.alias(n) for n, c in joined.items()))


def text_in_order(text: str, order: list[str], by: str = "") -> Column:
    """Aggregate: texts joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda x: x["_t"]), by)


def first_rows(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def repeats(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """All but the first of the rows with equal keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn > 1").drop("_rn")


def kth_to_kth(left: DataFrame, right: DataFrame, label: str, left_order: list[str], right_order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The k-th left row of a label with its k-th right row; both unmatched sides stay, with null for the other."""
    keys = keys or []
    number = lambda df, order: df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys, label).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*keys, label, "occurrence"], "full_outer")


def chapter_numbers(rows: DataFrame, keys: list[str], order: list[str], is_chapter: Column, counts: Column) -> DataFrame:
    """chapter_no and section_no of rows in order; a chapter row that does not count has number null, its sections too."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_group", F.sum(is_chapter.cast("int")).over(w)).withColumn("_n", F.sum((is_chapter & counts).cast("int")).over(w)).withColumn("_counts", F.last(F.when(is_chapter, counts), ignorenulls=True).over(w))
    w2 = Window.partitionBy(*keys, "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("chapter_no", F.when(F.col("_counts"), F.col("_n"))).withColumn("section_no", F.when(F.col("_counts") & ~is_chapter, F.sum((~is_chapter).cast("int")).over(w2))).drop("_group", "_n", "_counts")


def forward_match(headings: DataFrame, pages: DataFrame, keys: list[str], order: str, heading: str, page: str, text: str) -> DataFrame:
    """Each heading, in order, with the first page at or after the previous hit that contains it.

    Sequential by nature within a key: the key's pages, few and short, meet in one
    array and a fold walks the headings.
    """
    flat = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    ps = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(page).cast("int").alias("p"), flat(F.col(text)).alias("t")))).alias("ps"))
    hs = headings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(heading).alias("h"), flat(F.col(heading)).alias("t")))).alias("hs"))
    step = lambda acc, h: F.struct(
        F.coalesce(F.get(F.filter("ps", lambda p: (p["p"] >= acc["at"]) & p["t"].contains(h["t"])), F.lit(0))["p"], acc["at"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct(h["o"].alias("o"), h["h"].alias("h"), F.get(F.filter("ps", lambda p: (p["p"] >= acc["at"]) & p["t"].contains(h["t"])), F.lit(0))["p"].alias("page")))).alias("out"),
    )
    order_type = headings.schema[order].dataType.simpleString()
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<struct<o:{order_type},h:string,page:int>>)").alias("out"))
    return hs.join(ps, keys).select(*keys, F.explode(F.aggregate("hs", zero, step, lambda a: a["out"])).alias("x")).select(*keys, F.col("x.o").alias(order), F.col("x.h").alias(heading), F.col("x.page").alias(page))
