"""Word packages: parts, relationships, and body blocks as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def parts(files: DataFrame) -> DataFrame:
    """path, part, size, sha256 of each member of (path, content) packages; error for what is no package."""

    def run(batches):
        import hashlib
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        rows += [(path, n, len(d := z.read(n)), hashlib.sha256(d).hexdigest(), None) for n in z.namelist()]
                except (zipfile.BadZipFile, OSError) as e:
                    rows.append((path, None, None, None, type(e).__name__))
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "part", "size", "sha256", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, part string, size long, sha256 string, error string")


def _read(content: bytes) -> list[tuple]:
    import io
    import zipfile
    from xml.etree import ElementTree

    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")

    def text(e, view: str) -> str:
        parts = []
        for n in e.iter():
            if n.tag == f"{W}t" or (view == "original" and n.tag == f"{W}delText"):
                parts.append(n.text or "")
            elif n.tag in (f"{W}tab", f"{W}br"):
                parts.append(" ")
        return "".join(parts)

    def without(e, tag: str):
        import copy

        e = copy.deepcopy(e)
        for parent in list(e.iter()):
            for child in [c for c in parent if c.tag == f"{W}{tag}"]:
                parent.remove(child)
        return e

    for e in body if body is not None else []:
        kind = {f"{W}p": "p", f"{W}tbl": "tbl"}.get(e.tag)
        if kind is None:
            continue
        style = e.find(f"{W}pPr/{W}pStyle")
        cells = [[text(without(c, "del"), "accepted") for c in r.findall(f"{W}tc")] for r in e.findall(f"{W}tr")]
        drawing = any(n.tag in (f"{W}drawing", f"{W}pict") for n in e.iter())
        revised = any(n.tag in (f"{W}ins", f"{W}del") for n in e.iter())
        out.append((kind, "" if style is None else style.get(f"{W}val", ""), text(without(e, "del"), "accepted"), text(without(e, "ins"), "original"), cells, drawing, revised))
    return out


def blocks(files: DataFrame) -> DataFrame:
    """path, ordinal, kind, style, text (changes taken), original (changes refused), cells, drawing, revised, error."""

    def run(batches):
        import pyarrow as pa

        types = {"path": pa.string(), "ordinal": pa.int32(), "kind": pa.string(), "style": pa.string(), "text": pa.string(), "original": pa.string(), "cells": pa.list_(pa.list_(pa.string())), "drawing": pa.bool_(), "revised": pa.bool_(), "error": pa.string()}
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(path, i, *r, None) for i, r in enumerate(_read(content))]
                except Exception as e:  # one broken package is a row, not a failed job
                    rows.append((path, None, None, None, None, None, None, None, None, f"docx.{type(e).__name__}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], names=list(types))

    return files.select("path", "content").mapInArrow(run, "path string, ordinal int, kind string, style string, text string, original string, cells array<array<string>>, drawing boolean, revised boolean, error string")


def semantic(files: DataFrame) -> DataFrame:
    """Blocks of packages under the schema that the Markdown reader has: headings by style, tables, images, paragraphs; comments and revisions are taken as accepted."""
    b = blocks(files)
    level = F.regexp_extract("style", r"(?i)^heading\s*([1-6])$", 1)
    kind = F.when(F.col("error").isNotNull(), "error").when(F.col("kind") == "tbl", "table").when(level != "", "heading").when(F.lower("style") == "title", "heading").when(F.col("drawing"), "image").when(F.lower("style").startswith("list"), "bullet").otherwise("paragraph")
    held = b.withColumn("what", kind).where("what <> 'paragraph' or trim(text) <> ''")
    depth = F.when(level != "", level.cast("int")).when(F.col("what") == "heading", 1).otherwise(0)
    empty = F.array().cast("array<string>")
    return held.select(
        F.xxhash64("path").alias("doc_id"), F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.col("what").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), depth.alias("level"), F.when(F.col("what") == "table", F.col("cells")).alias("cells"),
        F.lit("").alias("language"), F.lit("").alias("path"), F.create_map(F.lit("style"), F.coalesce("style", F.lit(""))).alias("options"), F.when(F.col("what") == "table", F.transform(F.coalesce(F.try_element_at("cells", F.lit(1)), empty), lambda _: F.lit(""))).alias("alignments"), "error",
    )


def block_map(files: DataFrame) -> DataFrame:
    """doc_id, ordinal, key, opaque: what an edit can be mapped onto; tables and drawings are opaque."""
    from ..functions.inline import inline_key

    b = blocks(files).where("error is null")
    return b.select(F.xxhash64("path").alias("doc_id"), "ordinal", inline_key(F.coalesce("text", F.lit(""))).alias("key"), ((F.col("kind") != "p") | F.col("drawing")).alias("opaque"), "text")


def versions(files: DataFrame, accepted: bool = True) -> DataFrame:
    """doc_id, ordinal, kind, style, text, drawing as alignments take them, with changes taken or refused."""
    b = blocks(files).where("error is null")
    text = F.col("text") if accepted else F.col("original")
    return b.select(F.xxhash64(F.regexp_extract("path", r"([^/]+)$", 1)).alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"), "kind", "style", text.alias("text"), F.when(F.col("drawing"), "drawing").alias("drawing"))


def relationships(files: DataFrame) -> DataFrame:
    """path, owner, rel_id, target, external, used: what parts declare and refer to."""

    def run(batches):
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        import pyarrow as pa

        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    continue
                for n in z.namelist():
                    if m := re.match(r"(.*?)_rels/([^/]+)\.rels$", n):
                        rows += [(path, m[1] + m[2], e.get("Id"), e.get("Target"), e.get("TargetMode") == "External", False) for e in ElementTree.fromstring(z.read(n))]
                    elif n.endswith(".xml"):
                        rows += [(path, n, v, None, None, True) for e in ElementTree.fromstring(z.read(n)).iter() for k, v in e.attrib.items() if k.startswith(R)]
            types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "owner", "rel_id", "target", "external", "used"])

    return files.select("path", "content").mapInArrow(run, "path string, owner string, rel_id string, target string, external boolean, used boolean")


def audit(files: DataFrame) -> DataFrame:
    """path, code, owner, item: relationship targets that are no part, and ids that nothing declares."""
    from ..functions.text import package_target

    rel, held = relationships(files), parts(files).where("part is not null").select("path", F.col("part").alias("name"))
    said = rel.where("not used and not external").withColumn("name", package_target(F.col("owner"), F.col("target")))
    gone = said.join(held, ["path", "name"], "left_anti").select("path", F.lit("package.target_missing").alias("code"), "owner", F.col("target").alias("item"))
    asked = rel.where("used").select("path", "owner", "rel_id").distinct()
    loose = asked.join(rel.where("not used").select("path", "owner", "rel_id"), ["path", "owner", "rel_id"], "left_anti").select("path", F.lit("package.dangling_id").alias("code"), "owner", F.col("rel_id").alias("item"))
    return gone.unionByName(loose)
