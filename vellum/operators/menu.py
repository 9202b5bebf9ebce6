"""The menu tree: nested modules and topics, flattened to rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.kernels import lazy_udf

NODE = (
    "struct<ord:int,depth:int,kind:string,id:string,title:string,name:string,own_name:string,bad_name:boolean,target:string,dropbox:string,has_dropbox:boolean,"
    "has_qr:boolean,qr:string,extra_targets:array<string>,module_path:array<string>,hidden:boolean,first_id:boolean>"
)
#: Signs that a module name may not hold.
NAME_SIGNS = ":()"


def menu_rows(text: str) -> dict:
    """{error, rows, ids} of a menu document.

    Rows are targets (page, file, instructions), topics and modules in document order;
    ids are all values of the key id, anywhere.  A module hands its name and its
    hidden flag down to what lies below it.
    """
    out: dict = {"error": None, "rows": [], "ids": []}
    try:
        doc = json.loads(text)
    except ValueError as e:
        out["error"] = f"not valid JSON: {e}"
        return out

    def ids(x) -> None:
        if isinstance(x, dict):
            if "id" in x:
                v = x["id"]
                out["ids"].append({"value": v if isinstance(v, str) else json.dumps(v), "is_text": isinstance(v, str)})
            for v in x.values():
                ids(v)
        elif isinstance(x, list):
            for v in x:
                ids(v)

    def text_or_none(x):
        return x if isinstance(x, str) else None

    def add(item: dict, kind: str, depth: int, path: list[str], name: str | None, hidden: bool, **more) -> None:
        qr = item.get("qr")
        row = {
            "ord": len(out["rows"]), "depth": depth, "kind": kind, "id": text_or_none(item.get("id")), "title": text_or_none(item.get("title")), "name": name, "own_name": None, "bad_name": False, "target": None,
            "dropbox": text_or_none(item.get("dropbox")), "has_dropbox": "dropbox" in item, "has_qr": "qr" in item, "qr": json.dumps(qr) if "qr" in item else None,
            "extra_targets": [k for k in ("page", "file", "dropbox") if k in item], "module_path": list(path), "hidden": hidden, "first_id": True,
        }
        out["rows"].append(row | more)

    def walk(item, depth: int, path: list[str], name: str | None, hidden: bool) -> None:
        if not isinstance(item, dict):
            return
        below = item.get("items")
        hidden = hidden or bool(item.get("hidden"))
        if isinstance(below, list):
            own = item.get("name")
            bad = own is not None and (not isinstance(own, str) or not own.strip() or own != own.strip() or any(s in own for s in NAME_SIGNS))
            add(item, "module", depth, path, name, hidden, own_name=None if bad else own, bad_name=bad)
            name = own if own is not None and not bad else name
            for child in below:
                walk(child, depth + 1, [*path, str(item.get("title", ""))], name, hidden)
        else:
            add(item, "topic", depth, path, name, hidden)
        for kind in ("page", "file", "instructions"):
            if isinstance(item.get(kind), str):
                add(item, kind, depth, path, name, hidden, target=item[kind])

    ids(doc)
    for module in doc.get("modules", []) if isinstance(doc, dict) and isinstance(doc.get("modules", []), list) else []:
        walk(module, 0, [], None, False)
    return out


def _rows_of(docs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([menu_rows(d) for d in docs], columns=["error", "rows", "ids"])


_parse = lazy_udf(_rows_of, f"struct<error:string,rows:array<{NODE}>,ids:array<struct<value:string,is_text:boolean>>>")


def flatten(docs: DataFrame) -> DataFrame:
    """docs(path, doc) to path, error, rows, ids: one row for each menu."""
    return docs.select("path", _parse("doc").alias("m")).select("path", "m.*")


def rows(menu: DataFrame) -> DataFrame:
    """One row for each node of the flattened menus."""
    return menu.select("path", F.explode("rows").alias("n")).select("path", "n.*")


def repeated_ids(menu: DataFrame) -> DataFrame:
    """path, pos, value, is_text, repeat: repeat is true from the second of equal ids on."""
    ids = menu.select("path", F.posexplode("ids").alias("pos", "i")).select("path", "pos", "i.*")
    return ids.withColumn("repeat", F.row_number().over(Window.partitionBy("path", "value").orderBy("pos")) > 1)


def category_path(c: str = "module_path") -> Column:
    return F.array_join(c, " > ")


def menu_path(c: str = "module_path") -> Column:
    """Titles from the top, without the leading number of each."""
    return F.transform(c, lambda t: F.regexp_replace(t, r"^\d+\.\s*", ""))


def common_prefix(pages: DataFrame, keys: list[str], path: str) -> DataFrame:
    """For each key, the leading elements on which the paths of all its rows agree.

    Element-wise: a position counts if all rows have the same element there and all
    earlier positions count; only short arrays meet in an aggregate, not rows.
    """
    at = pages.select(*keys, F.size(path).alias("n"), F.posexplode(path).alias("pos", "e"))
    rows_of = pages.groupBy(*keys).agg(F.count("*").alias("rows"))
    per = at.groupBy(*keys, "pos").agg(F.min("e").alias("lo"), F.max("e").alias("hi"), F.count("*").alias("have"))
    marked = per.join(rows_of, keys).select(*keys, "pos", "lo", ((F.col("lo") == F.col("hi")) & (F.col("have") == F.col("rows"))).alias("same"))
    w = Window.partitionBy(*keys).orderBy("pos")
    kept = marked.withColumn("ok", F.min(F.col("same").cast("int")).over(w)).where("ok = 1")
    joined = kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lo"))), lambda x: x["lo"]).alias("prefix"))
    return rows_of.join(joined, keys, "left").select(*keys, F.coalesce("prefix", F.expr("cast(array() as array<string>)")).alias("prefix"))
