"""Course packages: an archive with a manifest of topics, documents and dropboxes."""

from __future__ import annotations

import re
from urllib.parse import unquote
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.kernels import vectorised

TOPIC = "struct<ord:int,title:string,module:array<string>,hidden:boolean,href:string,kind:string,dropbox_code:string>"


def local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def attribute(el, name: str, default: str = "") -> str:
    return next((v for k, v in el.attrib.items() if local(k) == name), default)


def normal_href(href: str) -> str:
    """Percent decoding, backslashes to slashes, no leading slash or dot."""
    return re.sub(r"^(?:\./|/)+", "", unquote(href).replace("\\", "/"))


def manifest_topics(xml: str, doc_exts: tuple[str, ...] = (".pdf", ".zip")) -> list[dict]:
    """Topics in manifest order; what lies below a hidden module is hidden; module holds the titles above."""
    root = ET.fromstring(xml)
    resources = {attribute(r, "identifier"): (normal_href(attribute(r, "href")), attribute(r, "material_type") or attribute(r, "type"), attribute(r, "link_code")) for r in root.iter() if local(r.tag) == "resource"}
    out: list[dict] = []

    def walk(item, path: list[str], hidden: bool) -> None:
        title = next((c.text or "" for c in item if local(c.tag) == "title"), "").strip()
        hidden = hidden or attribute(item, "isvisible", "true").lower() == "false"
        below = [c for c in item if local(c.tag) == "item"]
        href, material, code = resources.get(attribute(item, "identifierref"), ("", "", ""))
        if href:
            low = href.lower().partition("?")[0]
            quick = re.search(r"(?:quicklink|type=dropbox).*?(?:rcode|code)=([\w-]+)", href, re.I)
            kind = "dropbox" if quick or code else "page" if low.endswith((".html", ".htm")) else "document" if low.endswith(doc_exts) else "link" if re.match(r"https?://", low) else "other"
            out.append({"ord": len(out) + 1, "title": title, "module": list(path), "hidden": hidden, "href": href, "kind": kind, "dropbox_code": (quick[1] if quick else code or None) if kind == "dropbox" else None})
        for c in below:
            walk(c, [*path, title] if title else path, hidden)

    for org in (o for o in root.iter() if local(o.tag) == "organization"):
        for item in (c for c in org if local(c.tag) == "item"):
            walk(item, [], False)
    return out


def dropboxes(xml: str) -> list[dict]:
    """Codes of an assignment list with their names and instructions."""
    out = []
    for el in ET.fromstring(xml).iter():
        if local(el.tag) in ("folder", "dropbox") and attribute(el, "resource_code"):
            text = next((c for c in el.iter() if local(c.tag) in ("text", "html", "instructions") and (c.text or "").strip()), None)
            out.append({"code": attribute(el, "resource_code"), "name": attribute(el, "name"), "html": text.text if text is not None else None})
    return out


def _safe(fn):
    def run(x):
        try:
            return fn(x)
        except ET.ParseError:
            return None

    return run


topics_udf = vectorised(_safe(manifest_topics), f"array<{TOPIC}>")
dropboxes_udf = vectorised(_safe(dropboxes), "array<struct<code:string,name:string,html:string>>")


def choose_manifest(entries: DataFrame, key: str = "path") -> DataFrame:
    """The shallowest, then shortest, manifest of each package: key, entry, bytes."""
    found = entries.where(F.lower(F.substring_index("entry", "/", -1)) == "imsmanifest.xml")
    rank = F.struct(F.size(F.split("entry", "/")), F.length("entry"), F.col("entry"))
    return found.groupBy(key).agg(F.min_by(F.struct("entry", "bytes"), rank).alias("m")).select(key, "m.*")


def topics(entries: DataFrame, key: str = "path") -> DataFrame:
    """Topics of each package; one without manifest has its pages in path order."""
    chosen = choose_manifest(entries, key)
    base = F.regexp_replace("entry", r"[^/]*$", "")
    listed = chosen.select(key, base.alias("base"), F.explode(topics_udf(F.decode("bytes", "UTF-8"))).alias("t")).select(key, "t.*", F.concat("base", "t.href").alias("zip_path"))
    bare = entries.join(chosen.select(key), key, "left_anti").where(F.lower("entry").rlike(r"\.html?$"))
    walked = bare.select(key, F.row_number().over(Window.partitionBy(key).orderBy("entry")).alias("ord"), F.regexp_replace(F.substring_index("entry", "/", -1), r"\.[^.]*$", "").alias("title"), F.expr("cast(array() as array<string>)").alias("module"), F.lit(False).alias("hidden"), F.col("entry").alias("href"), F.lit("page").alias("kind"), F.lit(None).cast("string").alias("dropbox_code"), F.col("entry").alias("zip_path"))
    return listed.unionByName(walked)


def locate(refs: DataFrame, entries: DataFrame, key: str, ref: str, base: str) -> DataFrame:
    """refs with found: the exact entry, else the only one that ends in that path, else the only one of that name; in any case of letters.

    A reference's path is percent-decoded.  From the root it is tried as it is, then as
    what is behind /content/enforced/<unit>/; else from the base folder with dots
    resolved, then as it is.  One equi-join: each reference asks for a few keys in order of
    rank, and each entry is filed under its path and its suffixes where they are its own.
    """
    path = tx.unquote(tx.url_path(ref))
    joined = tx.fold_path(F.concat_ws("/", F.nullif(F.col(base), F.lit("")), path))
    from_root = F.array(F.regexp_replace(path, "^/+", ""), tx.first(path, "/content/enforced/[^/]+/(.*)$"))
    tried = F.when(path.startswith("/"), from_root).otherwise(F.array(F.regexp_replace(joined, "^[./]+", ""), path))
    tried = F.filter(F.transform(tried, F.lower), lambda x: x.isNotNull() & (x != ""))
    name = F.substring_index(F.element_at("_tried", 1), "/", -1)
    as_kind = lambda k: F.transform("_tried", lambda x, i: F.struct(F.lit(k).alias("_kind"), i.alias("_nth"), x.alias("_s")))
    exact, ends = as_kind(0), as_kind(1)
    asked = F.concat(exact, ends, F.array(F.struct(F.lit(2).alias("_kind"), F.lit(0).alias("_nth"), name.alias("_s"))))
    rows = refs.select(key, ref, base).distinct().withColumn("_tried", tried).where((path != "") & (F.size("_tried") > 0))
    wants = rows.select(F.col(key).alias("_key"), F.col(ref).alias("_ref"), F.col(base).alias("_base"), F.explode(asked).alias("_w")).select("_key", "_ref", "_base", "_w.*")
    parts = F.split(F.lower("entry"), "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    filed = F.concat(
        F.array(F.struct(F.lit(0).alias("_kind"), F.regexp_replace(F.lower("entry"), "^/+", "").alias("_s"))),
        F.when(F.size(parts) > 1, F.transform(tails, lambda x: F.struct(F.lit(1).alias("_kind"), x.alias("_s")))).otherwise(F.expr("cast(array() as array<struct<_kind:int,_s:string>>)")),
        F.array(F.struct(F.lit(2).alias("_kind"), F.element_at(parts, -1).alias("_s"))),
    )
    index = entries.select(F.col(key).alias("_key"), "entry", F.explode(filed).alias("_f")).groupBy("_key", "_f._kind", "_f._s").agg(F.count("*").alias("_n"), F.max("entry").alias("_entry")).where("_kind = 0 or _n = 1")
    best = wants.join(index, ["_key", "_kind", "_s"]).groupBy("_key", "_ref", "_base").agg(F.min_by("_entry", F.struct("_kind", "_nth")).alias("found"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(ref) == F.col("_ref")) & F.col(base).eqNullSafe(F.col("_base"))
    return refs.join(best, same, "left").drop("_key", "_ref", "_base")


def only(topics: DataFrame, words: list[str]) -> DataFrame:
    """Topics whose `module > title` holds one of the words, in any case."""
    where = F.lower(F.concat_ws(" > ", F.array_join("module", " > "), "title"))
    hit = F.lit(False)
    for w in words:
        hit = hit | where.contains(w.lower())
    return topics.where(hit) if words else topics


def size_verdict(size: Column, max_mb: int = 50) -> Column:
    """Why a document is left out; null if it isn't."""
    return F.when(size > max_mb * 1024 * 1024, F.format_string("larger than %d MB", F.lit(max_mb)))


def import_totals(staged: DataFrame) -> DataFrame:
    """copied, reused, skipped of staged assets (reused boolean, reason string)."""
    return staged.agg(F.count_if(F.col("reason").isNull() & ~F.col("reused")).alias("copied"), F.count_if(F.col("reason").isNull() & F.col("reused")).alias("reused"), F.count_if(F.col("reason").isNotNull()).alias("skipped"))
