"""Desired against actual state: plans, coverage, variants, change status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.plans.gate import gated


class ReconcileError(ValueError):
    """What must be right before anything is written is not."""


def raise_if_any(errors: DataFrame, what: str, show: int = 10) -> None:
    """All or nothing: raise with the first few rows if errors has any."""
    first = errors.limit(show).collect()
    if first:
        raise ReconcileError(f"{what}: " + "; ".join(", ".join(map(str, r)) for r in first))


def plan(desired: DataFrame, existing: DataFrame, key: str, content: str, own: Column | None = None) -> DataFrame:
    """key, action: new, changed, same or orphan.

    A full outer join on the key.  own tells which existing rows may be orphans (by
    default all); foreign and null keys are left alone.
    """
    d = desired.select(F.col(key).alias("key"), F.col(content).alias("want"), F.lit(True).alias("in_d"))
    e = existing.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(content).alias("have"), (own if own is not None else F.lit(True)).alias("own"), F.lit(True).alias("in_e"))
    action = F.when(F.col("in_e").isNull(), "new").when(F.col("in_d").isNull(), F.when(F.col("own"), "orphan")).when(F.col("want").eqNullSafe(F.col("have")), "same").otherwise("changed")
    return d.join(e, "key", "full_outer").select("key", action.alias("action")).where("action is not null")


def action_plan(planned: DataFrame) -> DataFrame:
    """Requests for a plan: a changed row is deleted and made anew, an orphan only reported."""
    steps = F.when(F.col("action") == "new", F.array(F.lit("post"))).when(F.col("action") == "changed", F.array(F.lit("delete"), F.lit("post"))).when(F.col("action") == "orphan", F.array(F.lit("report"))).otherwise(F.expr("cast(array() as array<string>)"))
    return planned.select("key", "action", F.posexplode(steps).alias("step", "request"))


def ready(planned: DataFrame) -> DataFrame:
    """One row: whether nothing is new or changed, and how much is."""
    return planned.agg(F.count_if(F.col("action") == "new").alias("n_new"), F.count_if(F.col("action") == "changed").alias("n_changed")).withColumn("ready", F.col("n_new") + F.col("n_changed") == 0)


def flatten_settings(docs: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """keys, field, value (source text), of JSON objects; nested one level as object.field.

    Keys that begin with _ are comments; a null is "not set" and left out.
    """
    top = docs.select(*keys, F.explode(F.from_json(doc, "map<string,string>")).alias("_k", "_v")).where(~F.col("_k").startswith("_") & F.col("_v").isNotNull())
    nested = top.where(F.col("_v").startswith("{")).select(*keys, "_k", F.explode(F.from_json("_v", "map<string,string>")).alias("_k2", "_v2")).where(~F.col("_k2").startswith("_") & F.col("_v2").isNotNull())
    flat = top.where(~F.col("_v").startswith("{")).select(*keys, F.lit(None).cast("string").alias("object"), F.col("_k").alias("field"), F.col("_v").alias("value"))
    return flat.unionByName(nested.select(*keys, F.col("_k").alias("object"), F.col("_k2").alias("field"), F.col("_v2").alias("value")))


def setting_changes(desired: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys, object, field, want, have: settings that differ, by the equality of JSON values.

    desired and actual have keys, object, field, value and kind (see text.json_kind).
    """
    a = actual.select(*keys, F.coalesce("object", F.lit("")).alias("o"), "field", F.col("value").alias("have"), F.col("kind").alias("have_kind"))
    d = desired.select(*keys, "object", F.coalesce("object", F.lit("")).alias("o"), "field", F.col("value").alias("want"), F.col("kind").alias("want_kind"))
    j = d.join(a, [*keys, "o", "field"], "left")
    same = tx.same_value(F.col("want"), F.col("want_kind"), F.col("have"), F.coalesce("have_kind", F.lit("absent")))
    return j.where(~F.coalesce(same, F.lit(False))).select(*keys, "object", "field", "want", "have")


def settings_plan(desired: DataFrame, actual: DataFrame, keys: list[str], partial: list[str]) -> DataFrame:
    """keys, object, body: what to send.

    A plain object goes whole when any of its fields differs: what it has now, overlaid by
    the wanted fields.  Objects in `partial` send only the fields that differ.
    """
    changed = setting_changes(desired, actual, keys)
    part = changed.where(F.col("object").isNull() | F.col("object").isin(*partial)).select(*keys, "object", "field", F.col("want").alias("value"))
    whole = changed.where(F.col("object").isNotNull() & ~F.col("object").isin(*partial)).select(*keys, "object").distinct()
    layers = desired.select(*keys, "object", "field", "value", F.lit(1).alias("_layer")).unionByName(actual.select(*keys, "object", "field", "value", F.lit(0).alias("_layer")))
    full = layers.join(whole, [*keys, "object"], "left_semi").groupBy(*keys, "object", "field").agg(F.max_by("value", "_layer").alias("value"))
    both = part.unionByName(full)
    return both.groupBy(*keys, "object").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("body"))


def sequence_changes(want: DataFrame, have: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """keys, added, removed, reordered: ordered lists compared as sets and as sequences."""
    w, h = want.select(*keys, F.col(ids).alias("w")), have.select(*keys, F.col(ids).alias("h"))
    empty = lambda c: F.coalesce(c, F.array())
    j = w.join(h, keys, "full_outer").withColumn("w", empty("w")).withColumn("h", empty("h"))
    added, removed = F.array_except("w", "h"), F.array_except("h", "w")
    return j.select(*keys, added.alias("added"), removed.alias("removed"), ((F.size(added) + F.size(removed) == 0) & (F.col("w") != F.col("h"))).alias("reordered"))


def content_plan(n_want: Column, n_have: Column, same: Column) -> Column:
    """What to do with a test's questions: create, keep, replace (only when it is empty) or keep with a warning."""
    return F.when(n_have.isNull(), "create").when(same, "keep").when(n_have == 0, "replace").otherwise("keep-with-warning")


def live(rows: DataFrame, trashed: str = "trashed") -> DataFrame:
    """Rows that are not in the trash; an unknown flag is none."""
    return rows.where(~F.coalesce(F.col(trashed), F.lit(False)))


def at_most_one(rows: DataFrame, key: str, id: str, trashed: str | None = None) -> DataFrame:
    """Keys with more than one row, live if the trash column is named, with their ids: errors of a lookup by external id."""
    rows = live(rows, trashed) if trashed else rows
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(id)).alias("ids")).where("n > 1")


def by_external_id(wanted: DataFrame, rows: DataFrame, key: str, id: str, trashed: str | None = None) -> DataFrame:
    """wanted with the id of its only live row, null without one; keys with several are told together with their ids (gate.Invalid).

    The ids of a key are counted and bounded before they are named, so a key that very many rows share does no harm.
    """
    rows = live(rows, trashed) if trashed else rows
    per = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min(id).alias(id), F.max(id).alias("_last"))
    found = wanted.join(per, key, "left")
    label = F.concat(F.col(key).cast("string"), F.lit(": "), F.col("_n").cast("string"), F.lit(" rows, "), F.col(id).cast("string"), F.lit(" to "), F.col("_last").cast("string"))
    return gated(found, {"external ids of several rows": F.col("_n") > 1}, label).drop("_n", "_last")


def coverage(objects: DataFrame, sources: DataFrame, covered: DataFrame, keys: list[str], source: str) -> DataFrame:
    """objects with status: no-source, covered (any source is) or uncovered.

    sources(keys, source) exploded; covered(source).  Semi join and bool_or.
    """
    hit = covered.select(F.col(source)).distinct().withColumn("hit", F.lit(True))
    per = sources.join(hit, source, "left").groupBy(*keys).agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("any_hit"))
    j = objects.join(per, keys, "left")
    return j.withColumn("status", F.when(F.col("any_hit").isNull(), "no-source").when(F.col("any_hit"), "covered").otherwise("uncovered")).drop("any_hit")


def coverage_ratio(expected: DataFrame, covered: DataFrame, group: list[str], item: str) -> DataFrame:
    """group, expected, covered, ratio, uncovered (sorted items)."""
    hit = covered.select(item).distinct().withColumn("hit", F.lit(True))
    j = expected.join(hit, item, "left")
    return j.groupBy(*group).agg(F.count("*").alias("expected"), F.count("hit").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col(item)))).alias("uncovered")).withColumn("ratio", F.col("covered") / F.col("expected"))


#: The four combinations of export flags, in their fixed order.
VARIANTS = [(0, False, False), (1, False, True), (2, True, False), (3, True, True)]


def best_variant(matches: DataFrame, keys: list[str], variant: str, n: str) -> DataFrame:
    """keys, variant, n: the variant with the most matches, the first of equals."""
    return matches.groupBy(*keys).agg(F.max_by(F.struct(variant, n), F.struct(F.col(n), -F.col(variant))).alias("b")).select(*keys, f"b.{variant}", f"b.{n}")


def staleness(desired: DataFrame, existing: DataFrame, keys: list[str], item: str, content: str) -> DataFrame:
    """keys, variant, n_same, n_new, n_changed, n_orphan for the variant that fits best.

    desired has a row for each variant of each item (a cross join with the four
    variants above); existing has what is there.
    """
    d = desired.select(*keys, "variant", item, F.col(content).alias("want"))
    e = existing.select(*keys, item, F.col(content).alias("have"))
    per = d.join(e, [*keys, item], "left").groupBy(*keys, "variant").agg(F.count_if(F.col("want").eqNullSafe(F.col("have"))).alias("n_same"), F.count_if(F.col("have").isNull()).alias("n_new"), F.count("*").alias("n_want"))
    chosen = per.join(best_variant(per, keys, "variant", "n_same").select(*keys, "variant"), [*keys, "variant"], "left_semi")
    there = e.groupBy(*keys).agg(F.count("*").alias("n_have"))
    out = chosen.join(there, keys, "left").withColumn("n_have", F.coalesce("n_have", F.lit(0)))
    changed = F.col("n_want") - F.col("n_same") - F.col("n_new")
    return out.select(*keys, "variant", "n_same", "n_new", changed.alias("n_changed"), (F.col("n_have") - F.col("n_same") - changed).alias("n_orphan"))


def change_status(now: DataFrame, before: DataFrame | None, key: str, hash: str) -> DataFrame:
    """key, hash, status: '' on the first run or when equal, else new or changed."""
    if before is None:
        return now.select(key, hash, F.lit("").alias("status"))
    b = before.select(F.col(key), F.col(hash).alias("_was"))
    status = F.when(F.col("_was").isNull(), "new").when(F.col("_was") != F.col(hash), "changed").otherwise("")
    return now.join(b, key, "left").select(key, hash, status.alias("status"))


def merged_snapshot(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """The new snapshot: present keys with their new values, absent ones kept."""
    return now.select(*now.columns).unionByName(before.join(now.select(key), key, "left_anti").select(*now.columns))


def decision(proposal: Column, text: Column, footer: str, exempt: Column | None = None) -> tuple[Column, Column]:
    """(kind, text to publish) of a reviewed row: empty, proposal or adjusted; the footer goes below what is not exempt."""
    blank = tx.squeeze(F.coalesce(text, F.lit(""))) == ""
    kind = F.when(blank, "empty").when(tx.same_text(proposal, text), "proposal").otherwise("adjusted")
    foot = F.when((exempt if exempt is not None else F.lit(False)) | F.lit(not footer), text).otherwise(F.concat(text, F.lit("\n\n" + footer)))
    return kind, F.when(~blank, foot)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a beyond their number in b, side = 'only_a', and the reverse."""
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b")))


def majority(rows: DataFrame, keys: list[str], value: str, least: int = 4, share: float = 0.5) -> DataFrame:
    """keys, value, n, total where one value holds more than `share` of at least `least` rows; the lower of equals."""
    per = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    out = per.withColumn("total", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), value)))
    return out.where((F.col("rn") == 1) & (F.col("total") >= least) & (F.col("n") > share * F.col("total"))).drop("rn")


def longest_is_marked(rows: DataFrame, keys: list[str], size: Column, marked: Column, factor: float = 1.15, margin: int = 10) -> DataFrame:
    """Keys whose marked row is longer than all others, by factor and by margin."""
    per = rows.groupBy(*keys).agg(F.max(F.when(marked, size)).alias("marked_len"), F.max(F.when(~marked, size)).alias("other_len"))
    return per.where((F.col("marked_len") >= factor * F.col("other_len")) & (F.col("marked_len") - F.col("other_len") >= margin))


#: Sub-objects of a test that are read and set on their own, and what an item-bank test keeps (fixed values).
PARTS, ITEM_BANK_PARTS = ("cover", "publication"), ("grades_settings", "cover")


def configured_parts(settings: DataFrame, keys: list[str], doc: str, item_bank: bool = False) -> DataFrame:
    """keys, part, value (JSON): the sub-objects that a test's settings configure, which are all that is read back."""
    names = ITEM_BANK_PARTS if item_bank else PARTS
    parts = F.explode(F.map_filter(F.from_json(doc, "map<string,string>"), lambda k, v: k.isin(*names) & ~F.coalesce(v, F.lit("")).isin("", "{}", "[]", "null", "false")))
    return settings.select(*keys, parts.alias("part", "value"))


def manual_rows(settings: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """keys, ord, text: what has to be checked by hand, in the order of the settings."""
    listed = F.from_json(F.get_json_object(doc, "$.met_de_hand"), "array<string>")
    return settings.select(*keys, F.posexplode(listed).alias("ord", "text"))


def shortened(value: Column, most: int = 60) -> Column:
    """A value for display, its end cut off beyond so many characters."""
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.substring(value, 1, most - 3), F.lit("...")))


def by_name(rows: DataFrame, name: str, *then: str) -> DataFrame:
    """In the order of names, whatever their case."""
    return rows.orderBy(F.lower(name), *then)
