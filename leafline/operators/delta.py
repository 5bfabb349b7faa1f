"""Edits back onto a source: matching blocks, planning replacements, chunks of lines, running-text numbers."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import bounds, checkpointed, ratio, sign_counts

# When two block keys are one block, and by how much a key has to beat the next one.
LIKE, SHORT_KEY, SHORT_EDITS, MARGIN = 0.92, 8, 1, 0.04


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def near_keys(left: list[str], right: list[str]) -> list[tuple]:
    """For each left key (positions, ratios) of the right keys that are like it without being it.

    Beside a next key that is nearly as like, a match counts only in a run of repeats, where the
    next left key is that next key too.
    """
    sizes, signs = np.array([len(k) for k in right]), sign_counts(right)
    out = []
    for i, key in enumerate(left):
        found = []
        if key and right:
            reach = bounds(sign_counts([key])[0], len(key), signs, sizes) >= LIKE - 1e-9
            short = (sizes <= SHORT_KEY) & (len(key) <= SHORT_KEY) & (np.abs(sizes - len(key)) <= SHORT_EDITS)
            for j in np.flatnonzero((reach | short) & (sizes > 0)):
                if key == right[j]:
                    continue
                r = ratio(key, right[j])
                if r < LIKE and not (short[j] and levenshtein(key, right[j]) <= SHORT_EDITS):
                    continue
                after = right[j + 1] if j + 1 < len(right) else None
                repeats = after is not None and after == right[j] and i + 1 < len(left) and left[i + 1] == after
                if after is None or repeats or r - ratio(key, after) >= MARGIN:
                    found.append((j, r))
        out.append((np.array([j for j, _ in found], np.int64), np.array([r for _, r in found])))
    return out


def match_keys(left: list[str], right: list[str]) -> dict[int, int]:
    """An order-preserving match of left to right keys: the most pairs, of these the most equal ones, of these the highest sum of ratios.

    A key matches a merely similar one only if no right key is skipped right before it. One pass
    over rows from the end: ``free`` is the best from here on, ``strict`` the best after a skip.
    """
    n, m = len(left), len(right)
    pair, equal = 1 << 44, 1 << 24  # a pair outweighs any number of equal ones, and these any sum of ratios
    codes: dict = {}
    wanted, there = (np.array([codes.setdefault(k, len(codes)) if k else -1 for k in keys], np.int64) for keys in (left, right))
    near = near_keys(left, right)
    low = -(1 << 62)

    def gains(i: int):
        same = np.where((there == wanted[i]) & (wanted[i] >= 0), pair + equal + 1000, low)
        every = same.copy()
        j, r = near[i]
        every[j] = pair + np.rint(1000 * r).astype(np.int64)
        return same, every

    def step(k: int, below):
        free_below, strict_below = below
        same, every = gains(n - k)
        strict = strict_below.copy()
        np.maximum(strict[:-1], same + free_below[1:], out=strict[:-1])
        strict = np.maximum.accumulate(strict[::-1])[::-1]
        free = free_below.copy()
        np.maximum(free[:-1], np.maximum(every + free_below[1:], strict[1:]), out=free[:-1])
        return free, strict

    zero = np.zeros(m + 1, np.int64)
    row = checkpointed((zero, zero), step, n)
    out: dict[int, int] = {}
    i = j = 0
    skipped = False
    while i < n and j < m:
        here, below = row(n - i)[skipped][j], row(n - i - 1)
        if gains(i)[not skipped][j] + below[0][j + 1] == here:
            out[i] = j
            i, j, skipped = i + 1, j + 1, False
        elif below[skipped][j] == here:
            i += 1
        else:
            j, skipped = j + 1, True
    return out


def map_blocks(source: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, source_ordinal, target_ordinal of (doc_id, ordinal, key) blocks, exact keys before similar ones."""

    def run(left, right):
        import pyarrow as pa

        a, b = (sorted(t.to_pylist(), key=lambda r: r["slot"]["ordinal"]) for t in (left, right))
        found = match_keys([r["slot"]["key"] or "" for r in a], [r["slot"]["key"] or "" for r in b])
        doc = (a or b)[0]["doc_id"]
        return pa.table({"doc_id": pa.array([doc] * len(found), pa.int64()), "source_ordinal": pa.array([a[i]["slot"]["ordinal"] for i in found], pa.int64()), "target_ordinal": pa.array([b[j]["slot"]["ordinal"] for j in found.values()], pa.int64())})

    slot = lambda d: d.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.col("key").alias("key")).alias("slot")).groupBy("doc_id")
    return slot(source).cogroup(slot(target)).applyInArrow(run, "doc_id long, source_ordinal long, target_ordinal long")


def plan_delta(baseline: DataFrame, edited: DataFrame, allow_delete: bool = False) -> DataFrame:
    """doc_id, op (replace, insert, delete, refused), baseline_ordinal, edited_ordinal, text of (doc_id, ordinal, opaque, text) chunks.

    Opaque chunks cannot be replaced, and deletions are refused unless allowed.
    """

    def run(left, right):
        import pyarrow as pa

        a, b = (sorted(t.to_pylist(), key=lambda r: r["slot"]["ordinal"]) for t in (left, right))
        doc = (a or b)[0]["doc_id"]
        a, b = [r["slot"] for r in a], [r["slot"] for r in b]
        rows = []
        for op, i, j, k, l in SequenceMatcher(None, [x["text"] for x in a], [x["text"] for x in b], autojunk=False).get_opcodes():
            if op == "equal":
                continue
            both = min(j - i, l - k)
            for d in range(both):
                old, new = a[i + d], b[k + d]
                rows.append((doc, "refused" if old["opaque"] or new["opaque"] else "replace", old["ordinal"], new["ordinal"], new["text"]))
            rows += [(doc, "delete" if allow_delete and not x["opaque"] else "refused", x["ordinal"], None, None) for x in a[i + both : j]]
            rows += [(doc, "refused" if x["opaque"] else "insert", a[j - 1]["ordinal"] if j else None, x["ordinal"], x["text"]) for x in b[k + both : l]]
        cols = list(zip(*rows)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()])], names=["doc_id", "op", "baseline_ordinal", "edited_ordinal", "text"])

    slot = lambda d: d.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.col("opaque").alias("opaque"), F.col("text").alias("text")).alias("slot")).groupBy("doc_id")
    return slot(baseline).cogroup(slot(edited)).applyInArrow(run, "doc_id long, op string, baseline_ordinal long, edited_ordinal long, text string")


def line_chunks(lines: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, part, text) of ranges(doc_id, part, first, last) of lines, and (doc_id, code, part, line_no) of faults.

    Faults: ranges that overlap, and lines with text that no range covers. Overlap is seen by a
    running maximum of ends, not by comparing ranges pairwise.
    """
    before = F.max("last").over(Window.partitionBy("doc_id").orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1))
    overlap = ranges.withColumn("before", before).where("before >= first").select("doc_id", F.lit("chunk.overlap").alias("code"), "part", F.col("first").alias("line_no"))
    held = lines.join(ranges, "doc_id").where("line_no between first and last")
    bare = lines.where("trim(raw) <> ''").join(held.select("doc_id", "line_no").distinct(), ["doc_id", "line_no"], "left_anti").select("doc_id", F.lit("chunk.uncovered").alias("code"), F.lit(None).cast("string").alias("part"), "line_no")
    text = held.groupBy("doc_id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n").alias("text"))
    return text, overlap.unionByName(bare)


LISTED = re.compile(r"(?<![\w.])([A-Za-z]?)(\d+)(?:(?:\s*,\s*|,?\s+and\s+)\1(\d+)(?![\w.]*\d))+")


def collapse_listed(text: str | None) -> str | None:
    """Three or more numbers of one prefix in steps of one, listed in prose, as a range."""

    def one(m: re.Match) -> str:
        ns = [int(x) for x in re.findall(r"\d+", m[0])]
        return f"{m[1]}{ns[0]}–{m[1]}{ns[-1]}" if len(ns) >= 3 and all(b == a + 1 for a, b in zip(ns, ns[1:])) else m[0]

    return None if text is None else LISTED.sub(one, text)


def collapse_lists(c: Column) -> Column:
    import pandas as pd

    return F.pandas_udf(lambda s: pd.Series([collapse_listed(x) for x in s], dtype=object), "string")(c)


# Latin letters with marks and the letters they are without them.
MARKED = ("àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöōőřśšťùúûüūůűýÿžźż", "aaaaaaaaacccdeeeeeeeiiiiilnnnooooooorsstuuuuuuuyyzzz")


def surname_keys(refs: DataFrame) -> DataFrame:
    """doc_id, ordinal, key: ``surnameYYYY`` of (doc_id, ordinal, text), with a, b, c where it repeats.

    The first author stands before the first comma or semicolon; behind initials the surname is the
    last word, else the first one.
    """
    text = F.trim(F.regexp_replace("text", r"^\[\d+\]\s*", ""))
    words = F.filter(F.split(F.trim(F.regexp_extract(text, r"^([^;,]*)", 1)), r"\s+"), lambda w: w != "")
    initials = r"^(?:[A-Z]\.(?:-?[A-Z]\.)*|[A-Z])$"
    names = F.filter(words, lambda w: ~w.rlike(initials))
    surname = F.when(F.size(names) > 0, F.when(words[0].rlike(initials), F.element_at(names, -1)).otherwise(names[0]))
    plain = F.regexp_replace(F.translate(F.lower(surname), *MARKED), "[^a-z]", "")
    year = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)
    keyed = refs.withColumn("base", F.concat(F.coalesce(F.nullif(plain, F.lit("")), F.lit("ref")), year))
    k = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("ordinal"))
    return keyed.withColumn("k", k).select("doc_id", "ordinal", F.concat("base", F.when(F.col("k") == 1, "").otherwise(F.char(F.col("k") + 95))).alias("key"))
