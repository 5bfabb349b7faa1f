"""Personal data: pattern spans, and terms that give protected entities away.

Pattern spans (email, ip, card, phone) are the protected entities. A term is a word; how much it
reveals a kind c of entity follows from co-occurrence over the whole corpus (Sanchez and Batet,
"C-sanitized", 2016): with documents as events, IC(c) = -log2 p(c) is what there is to know, and
PMI(c; t) = log2(p(c, t) / (p(c) p(t))) is what t tells, where (c, t) means that t stands within
``window`` words of an entity of kind c. The disclosure PMI / IC is 1 if t never stands elsewhere.
Terms at or above ``remove`` are removed near such an entity, those at or above ``generalise`` are
replaced by what they stand for, however rare: a name that stands once, beside its address,
reveals all of it. ``support`` can ask for more documents near the entity than one. A term is a
run of three or more letters of any script: shorter words and numbers are never terms.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import like, released, staged

KINDS = ("email", "ip", "card", "phone")
#: An email's domain part; the local part is what stands before it. Equal to a search for the
#: whole pattern from the left, in linear time.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can begin inside a run of digits only where one could begin before it, hence the lookbehind.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")
#: Distinct terms that a task holds before it passes their counts on.
HELD = 100_000
NAMES = ("row", "doc_id", "spans", "near", "term", "kind", "n")
EVENTS = "row long, doc_id long, spans array<struct<kind:string,start:long,stop:long>>, near array<struct<kind:string,term:string,start:long,stop:long>>, term string, kind string, n long"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans (kind, start, end) in code points, by kind as listed, then start."""
    out, last = [], 0
    if "@" in text:
        for m in AT.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                last = m.end()
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(d := x.lstrip("0")) <= 3 and int(d or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.sub("", m[0])) <= 15]
    return out


def near_terms(text: str, spans: list[tuple[str, int, int]], window: int) -> list[tuple[str, str, int, int]]:
    """(kind, term, start, end) of the words within window words of a span, outside all spans."""
    if not spans:
        return []
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    taken = sorted((s, e) for _, s, e in spans)
    free, k = [], 0
    for s, e in words:
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if not any(a < e and s < b for a, b in taken[k : k + 4]):
            free.append((s, e))
    from bisect import bisect_left

    starts, found = [s for s, _ in free], set()
    for kind, s, e in spans:
        left, right = bisect_left(starts, s), bisect_left(starts, e)
        for a, b in free[max(0, left - window) : left] + free[right : right + window]:
            found.add((kind, text[a:b].lower(), a, b))
    return sorted(found)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _events(window: int) -> Callable:
    """Rows of two sorts from one reading of the texts: a document's spans, and counts of terms over a task.

    Columns beyond row, doc_id and text pass through with the documents' rows.
    """

    def run(batches):
        import pyarrow as pa

        near_type = pa.list_(pa.struct([("kind", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

        def counted(counts, carried):
            n = len(counts)
            terms, kinds = [t for t, _ in counts], [k for _, k in counts]
            cols = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, span_type), pa.nulls(n, near_type), pa.array(terms, pa.string()), pa.array(kinds, pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays([*cols, *(pa.nulls(n, f.type) for f in carried)], names=[*NAMES, *(f.name for f in carried)])

        counts: dict[tuple[str, str], int] = {}
        carried: list = []
        for b in batches:
            spans, nears, carried = [], [], list(b.schema)[3:]
            for t in b.column(2):
                text = t.as_py() or ""
                s = base_spans(text)
                near = near_terms(text, s, window)
                spans.append([{"kind": k, "start": x, "stop": y} for k, x, y in s])
                nears.append([{"kind": k, "term": w, "start": x, "stop": y} for k, w, x, y in near])
                for key in [(w, "") for w in set(WORD.findall(text.lower()))] + list({(w, k) for k, w, _, _ in near}) + [("", k) for k in {k for k, _, _ in s}] + [("", "")]:
                    counts[key] = counts.get(key, 0) + 1
                if len(counts) > HELD:
                    yield counted(counts, carried)
                    counts = {}
            n = b.num_rows
            cols = [b.column(0), b.column(1), pa.array(spans, span_type), pa.array(nears, near_type), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[3:]], names=[*NAMES, *(f.name for f in carried)])
        if counts:
            yield counted(counts, carried)
        counts = {}
        released()

    return run


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 4, support: int = 1, generalise: float = 0.9, remove: float = 0.98) -> DataFrame:
    """One row for each document: row, doc_id, spans, terms (kind, start, stop, removed).

    ``row`` tells rows apart whose ids repeat. Offsets are code points, ends exclusive.

    Defined cases: a null text counts as empty; a failing match is dropped and not retried; null
    ids keep their rows; other columns are not read; an empty table gives no rows.
    """
    events = staged(_read(docs, id_col, text_col, window), like(docs))
    return _found(events, support, generalise, remove).select("row", "doc_id", "spans", "terms")


def _read(docs: DataFrame, id_col: str, text_col: str, window: int, *carried: Column) -> DataFrame:
    read = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *carried)
    schema = StructType([*_parse_datatype_string(EVENTS).fields, *read.schema.fields[3:]])
    return read.mapInArrow(_events(window), StructType([StructField(f.name, f.dataType, True) for f in schema]))


def _found(events: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
    """The documents' rows of events with terms: the near ones that disclose their kind of entity."""
    found = events.where("term is null")
    per_term = events.where("term is not null").groupBy("term", "kind").agg(F.sum("n").alias("n"))
    totals = {r["kind"]: r["n"] for r in per_term.where("term = ''").collect()}  # five rows
    both = events.where("term <> '' and (kind = '' or kind is not null)").groupBy("term").agg(F.sum(F.when(F.col("kind") == "", F.col("n"))).alias("alone"), *(F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in KINDS))
    n = max(totals.get("", 0), 1)
    told = []
    for k in KINDS:
        if (c := totals.get(k, 0)) and c < n:
            pmi = F.log2(F.col(k) * F.lit(float(n)) / (F.lit(float(c)) * F.col("alone")))
            told.append(F.when(F.col(k) >= support, F.struct(F.lit(k).alias("kind"), (pmi / F.lit(_log2(n / c))).alias("disclosure"))))
    told = F.array(*told) if told else F.array().cast("array<struct<kind:string,disclosure:double>>")
    flagged = both.select("term", F.explode(F.filter(told, lambda x: x["disclosure"] >= generalise)).alias("x")).select("term", "x.kind", "x.disclosure")
    near = found.where("size(near) > 0").select("row", F.explode("near").alias("x")).select("row", "x.term", "x.kind", "x.start", "x.stop")
    hits = near.join(flagged, ["term", "kind"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("kind"), F.col("start"), F.col("stop"), (F.col("disclosure") >= remove).alias("removed")))).alias("terms"))
    none = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,removed:boolean>>")
    told = found.where("size(near) > 0").join(hits, "row", "left").withColumn("terms", F.coalesce("terms", none))
    return told.unionByName(found.where("size(near) = 0").withColumn("terms", none))  # most documents take no part in the join


def _log2(x: float) -> float:
    from math import log2

    return log2(x)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 4, support: int = 1, generalise: float = 0.9, remove: float = 0.98) -> DataFrame:
    """docs with the text rewritten: entities to ``[KIND]``, terms removed or to ``[TERM]``.

    The columns stay; ``n_chars`` is brought up to date where there is one. The rows travel with
    their spans, so null and repeated ids are rewritten like any other.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("leafline_row")
    found = _found(staged(_read(docs, id_col, text_col, window, whole), like(docs)), support, generalise, remove)

    @F.pandas_udf("string")
    def clean(texts, spans, terms):
        import pandas as pd

        out = []
        for text, base, more in zip(texts, spans, terms):
            cuts = [(x["start"], x["stop"], f"[{x['kind'].upper()}]") for x in base]
            cuts += [(x["start"], x["stop"], "" if x["removed"] else "[TERM]") for x in more]
            parts, at = [], 0
            for s, e, mark in sorted(cuts, key=lambda c: (c[0], -c[1])):
                if s >= at:
                    parts += [text[at:s], mark]
                    at = e
                elif e > at:  # kinds may overlap: the rest of the later span goes too
                    at = e
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    told = found.where("size(spans) > 0").withColumn("leafline_text", clean(F.col("leafline_row")[text_col].cast("string"), "spans", "terms"))
    told = told.select("leafline_text", "leafline_row").unionByName(found.where("size(spans) = 0").select(F.col("leafline_row")[text_col].cast("string").alias("leafline_text"), "leafline_row"))
    size = {"n_chars": lambda kind: F.length("leafline_text").cast(kind)} if "n_chars" in docs.columns else {}
    column = lambda f: F.col("leafline_text") if f.name == text_col else size[f.name](f.dataType) if f.name in size else F.col("leafline_row")[f.name]
    return told.select(*(column(f).alias(f.name) for f in docs.schema))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of a find_private result."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])
    base = F.array_join(F.transform("spans", line), ",")
    term = lambda x: F.concat_ws(":", F.concat(F.lit("term_"), x["kind"]), x["start"], x["stop"])
    every = F.array_join(F.concat(F.transform("spans", line), F.transform("terms", term)), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
