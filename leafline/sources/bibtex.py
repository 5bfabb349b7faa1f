"""BibTeX and JSON bibliographies as rows doc_id, ordinal, key, entry_type, fields."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTRY = re.compile(r"@([\w-]+)\s*([{(])")
NAME = re.compile(r"\s*([\w:-]+)\s*=\s*")
SPACE = re.compile(r"\s+")
BLANK, HASH = re.compile(r"\s*"), re.compile(r"\s*#")
STOP = re.compile(r'\\.|[{}"]', re.S)


class Cursor:
    """A place in a text; each method reads one thing and moves on."""

    def __init__(self, text: str, at: int, closer: str):
        self.text, self.at, self.closer = text, at, closer
        self.bare = re.compile(rf"[^,}}\n#{re.escape(closer)}]*")

    def balanced(self) -> str:
        """What stands between braces, the first of which is behind the cursor."""
        start, depth = self.at, 1
        for m in STOP.finditer(self.text, self.at):
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if not depth:
                self.at = m.end()
                return self.text[start : m.start()]
        raise ValueError("bibtex.unclosed_value")

    def quoted(self) -> str:
        start = self.at
        for m in STOP.finditer(self.text, self.at):
            if m[0] == '"':
                self.at = m.end()
                return self.text[start : m.start()]
        raise ValueError("bibtex.unclosed_quote")

    def atom(self, macros: dict[str, str]) -> str:
        self.at = BLANK.match(self.text, self.at).end()
        first = self.text[self.at : self.at + 1]
        if first and first in '{"':
            self.at += 1
            return self.balanced() if first == "{" else self.quoted()
        m = self.bare.match(self.text, self.at)
        self.at = m.end()
        word = m[0].strip()
        return macros.get(word.lower(), word)

    def value(self, macros: dict[str, str]) -> str:
        """Atoms joined by ``#``; a hash without an atom behind it is text."""
        out = self.atom(macros)
        while m := HASH.match(self.text, self.at):
            before = self.at
            self.at = m.end()
            more = self.atom(macros)
            if not more and self.at == m.end():
                return out + self.text[before : self.at]
            out += more
        return out

    def skip(self, signs: str) -> None:
        while self.at < len(self.text) and self.text[self.at] in signs:
            self.at += 1

    def past(self, signs: str) -> None:
        while self.at < len(self.text) and self.text[self.at] not in signs:
            self.at += 1


def records(text: str | None) -> list[tuple[str, str, dict[str, str]]]:
    """(key, type, fields) in order. Malformed material is skipped to the next comma."""
    text, out, macros, at = text or "", [], {}, 0
    while m := ENTRY.search(text, at):
        c = Cursor(text, m.end(), "}" if m[2] == "{" else ")")
        kind = m[1]
        if kind.lower() == "string":
            if n := NAME.match(text, c.at):
                c.at = n.end()
                macros[n[1].lower()] = SPACE.sub(" ", c.value(macros)).strip()
            c.past(c.closer)
            at = c.at + 1
            continue
        start = c.at
        c.past("," + c.closer)
        key = text[start : c.at].strip()
        if text[c.at : c.at + 1] != ",":
            at = c.at
            continue
        c.at += 1
        fields: dict[str, str] = {}
        while c.at < len(text):
            c.skip(", \t\r\n\f\v")
            if text[c.at : c.at + 1] in ("", c.closer):
                c.at += 1
                break
            n = NAME.match(text, c.at)
            if not n:
                c.past("," + c.closer)
                continue
            c.at = n.end()
            fields[n[1].lower()] = SPACE.sub(" ", c.value(macros)).strip()
        if key:
            out.append((key, kind, fields))
        at = c.at
    return out


def bibtex(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ordinal, key, entry_type, fields, error: every record as written, repeats included."""
    schema = "doc_id long, ordinal int, key string, entry_type string, fields map<string,string>, error string"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(d, i, k, e, list(f.items()), None) for i, (k, e, f) in enumerate(records(t))]
                except ValueError as problem:
                    rows.append((d, None, None, None, None, str(problem)))
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "ordinal", "key", "entry_type", "fields", "error"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def entries(rows: DataFrame) -> DataFrame:
    """One row for each key of a document: the last definition, at the first one's place."""
    w = Window.partitionBy("doc_id", "key")
    last = F.row_number().over(w.orderBy(F.desc("ordinal")))
    return rows.where("key is not null").withColumn("place", F.min("ordinal").over(w)).withColumn("r", last).where("r = 1").select("doc_id", F.col("place").alias("ordinal"), "key", "entry_type", "fields")


def json_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Entries of a JSON object of records or raw strings; keys that begin with _ are left out."""
    table = F.from_json(F.col(text_col), "map<string,string>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.map_entries(table)).alias("ordinal", "e")).where(~F.col("e.key").startswith("_"))
    raw = ~F.col("e.value").startswith("{")
    inner = F.transform_keys(F.from_json("e.value", "map<string,string>"), lambda k, _: F.lower(k))
    fields = F.when(raw, F.create_map(F.lit("raw"), F.trim("e.value"))).otherwise(inner)
    kind = F.coalesce(inner["_type"], inner["entry_type"], F.lit("misc"))
    return rows.select("doc_id", "ordinal", F.col("e.key").alias("key"), F.when(raw, "misc").otherwise(kind).alias("entry_type"), F.map_filter(fields, lambda k, _: ~k.isin("_type", "entry_type")).alias("fields"))
