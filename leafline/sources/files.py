"""Files to documents, and the small formats around them: slides, prompts, section maps, style profiles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, format, text of every file under a path; ids are hashes of paths, so they last."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", T.source_format(F.col("path")).alias("format"), "text")


def binaries(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content, size, sha256, format of files as bytes."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "content", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def slides(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, title, bullets, error of JSON lists of slides."""
    rows = docs.select("doc_id", F.posexplode_outer(F.from_json("text", "array<struct<title:string,bullets:array<string>>>")).alias("ordinal", "s"))
    title = T.strip(F.coalesce("s.title", F.lit("")))
    bad = F.when(F.col("s").isNull(), "slides.invalid").when(title == "", "slides.title").when(F.exists(F.coalesce("s.bullets", F.array().cast("array<string>")), lambda b: b.isNull() | b.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")), "slides.text")
    return rows.select("doc_id", "ordinal", title.alias("title"), F.coalesce("s.bullets", F.array().cast("array<string>")).alias("bullets"), bad.alias("error"))


def prompts(docs: DataFrame, allowed: list[str]) -> DataFrame:
    """doc_id, meta, body, sha256, unknown: prompt files with ``key: value`` front matter of allowed keys."""
    p = r"(?s)^---\n(.*?)\n---\n(.*)$"
    head = F.filter(F.split(F.regexp_extract("text", p, 1), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(head, lambda x: F.struct(T.strip(F.substring_index(x, ":", 1)).alias("key"), T.strip(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    meta = F.map_from_entries(pairs)
    return docs.select("doc_id", F.map_filter(meta, lambda k, _: k.isin(allowed)).alias("meta"), T.strip(F.when(F.col("text").rlike(p), F.regexp_extract("text", p, 2)).otherwise(F.col("text"))).alias("body"), F.sha2("text", 256).alias("sha256"), F.filter(F.map_keys(meta), lambda k: ~k.isin(allowed)).alias("unknown"))


def select_prompts(files: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files(path) whose name or stem is wanted(name), wanted names that no file has), in path order."""
    named = files.withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("stem", F.regexp_replace("file", r"\.[^.]+$", ""))
    each = named.select("path", F.explode(F.array_distinct(F.array("file", "stem"))).alias("name"))
    return each.join(wanted.select("name"), "name", "left_semi").select("path").distinct().orderBy("path"), wanted.select("name").join(each, "name", "left_anti")


def section_map(docs: DataFrame) -> DataFrame:
    """doc_id, part, start, start_occurrence, end, end_occurrence, kind of JSON section maps; ``path`` is an old name of ``file``."""
    rows = docs.select("doc_id", F.explode(F.from_json(F.get_json_object("text", "$.sections"), "array<map<string,string>>")).alias("s"))
    ref = lambda k: (F.coalesce(F.get_json_object(F.col("s")[k], "$.heading"), F.col("s")[k]), F.coalesce(F.get_json_object(F.col("s")[k], "$.occurrence").cast("int"), F.lit(1)))
    (a, ao), (b, bo) = ref("start"), ref("end")
    return rows.select("doc_id", F.coalesce(F.col("s")["file"], F.col("s")["path"]).alias("part"), a.alias("start"), ao.alias("start_occurrence"), b.alias("end"), bo.alias("end_occurrence"), F.col("s")["kind"].alias("kind"))


def profile(text: str) -> dict:
    """A style profile from JSON or from a small part of YAML: nested mappings, scalars, flow mappings."""
    import json

    if text.lstrip().startswith("{"):
        return json.loads(text)
    root: dict = {}
    stack = [(-1, root)]
    for n, line in enumerate(text.splitlines(), 1):
        body = re.sub(r"(?:^|\s)#.*$", "", line).rstrip()
        if not body.strip():
            continue
        indent = len(body) - len(body.lstrip())
        m = re.match(r"\s*([^:{}\[\]]+?)\s*:\s*(.*)$", body)
        if not m:
            raise ValueError(f"profile.syntax: line {n}")
        while stack[-1][0] >= indent:
            stack.pop()
        held = stack[-1][1]
        if m[2]:
            held[m[1]] = _scalar(m[2])
        else:
            stack.append((indent, held.setdefault(m[1], {})))
    return root


def _scalar(s: str):
    s = s.strip()
    if s.startswith("{") and s.endswith("}"):
        return {k.strip(): _scalar(v) for k, _, v in (p.partition(":") for p in s[1:-1].split(",") if p.strip())}
    if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
        return s[1:-1]
    if s.lower() in ("true", "false"):
        return s.lower() == "true"
    if s.lower() in ("null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s
