"""Markdown to block rows: a state machine per document behind one Arrow boundary."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, ordinal int, kind string, text string, level int, cells array<array<string>>, language string, path string, "
    "options map<string,string>, alignments array<string>, error string"
)
# Line forms.
HEADING = re.compile(r"(#{1,6})\s+(.*)$")
IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)$")
ORDERED = re.compile(r"(\s*)(\d+)\.\s+(.*)$")
BULLET = re.compile(r"(\s*)[-*+]\s+(.*)$")
REFERENCE = re.compile(r"\[\d+\]\s+.*$")
NOTE = re.compile(r"table\s+(?:note|foot)\s*:\s*(.*)$", re.I)
LEGACY_NOTE = re.compile(r"\[([a-z])\]\s+.*$")
ESCAPED = re.compile(r"\\table\s+(?:note|foot|span|grouping|widths)\s*:", re.I)
LAYOUT = re.compile(r"table\s+(span|grouping|widths)\s*:\s*(\S+)\s*$", re.I)
NUMBERED = re.compile(r"(Table\s+[A-Za-z]*\d+)([.:])(\s*)(.*)$", re.I)
CAPTION = re.compile(r"Table\s*:\s*(.+)$", re.I)
AUTHORED = re.compile(r"Table\s+[A-Za-z]*\d+\b", re.I)
SEPARATOR = re.compile(r"\s*:?-{3,}:?\s*$")
LABEL = re.compile(r"\[([^\]]+)\]")
# Layout markers and what each may be.
MARKERS = {"span": {"column", "page"}, "grouping": {"auto", "off"}, "widths": {"fixed", "proportional"}}
FENCES = {"math": "equation", "tex": "equation", "latex": "equation", "algorithm": "algorithm", "pseudocode": "algorithm"}
SPANS = re.compile(r"\\.|(`+)|(\$+)|(\|)", re.S)


def split_row(line: str) -> list[str]:
    """Cells of a pipe row; pipes inside code or math, or behind a backslash, are text."""
    row = line.strip()
    row = row[1:] if row.startswith("|") else row
    row = row[:-1] if row.endswith("|") else row
    cells, cell, inside, at = [], "", "", 0
    for m in SPANS.finditer(row):
        cell += row[at : m.start()]
        at = m.end()
        mark = m[1] or m[2]
        if m[3] and not inside:
            cells.append(cell.strip())
            cell = ""
            continue
        if mark:
            if not inside:
                inside = mark
            elif inside == mark:
                inside = ""
            cell += mark
        else:
            cell += "|" if m[0] == "\\|" and not inside else m[0]
    return [*cells, (cell + row[at:]).strip()]


def is_row(line: str) -> bool:
    s = line.strip()
    return s.startswith("|") and s.endswith("|")


def starts_table(lines: list[str], i: int) -> bool:
    return i + 1 < len(lines) and is_row(lines[i]) and is_row(lines[i + 1]) and all(SEPARATOR.match(c) for c in split_row(lines[i + 1]))


def alignment(cell: str) -> str:
    return {(True, True): "center", (True, False): "left", (False, True): "right"}.get((cell.startswith(":"), cell.endswith(":")), "")


def has_display(line: str) -> bool:
    """``$$`` outside code and escapes."""
    inside = ""
    for m in re.finditer(r"\\.|`+|\$\$", line):
        if m[0].startswith("`"):
            inside = m[0] if not inside else "" if inside == m[0] else inside
        elif m[0] == "$$" and not inside:
            return True
    return False


class Problem(Exception):
    """Why a document cannot be read; becomes an error row."""


def markers(text: str) -> tuple[str, dict[str, str]]:
    kept, found = [], {}
    for k, part in enumerate(p.strip() for p in text.split("|")):
        key, eq, value = (x.strip().lower() for x in part.partition("="))
        if k and eq and key in MARKERS:
            if value not in MARKERS[key] or found.get(key, value) != value:
                raise Problem(f"table.marker: {key}={value}")
            found[key] = value
        else:
            kept.append(part)
    return " | ".join(kept).strip(), found


class Reader:
    """Blocks of one text. State: an open paragraph, pending layout marks, whether notes may follow."""

    def __init__(self, text: str, strip_comments: bool, notes: str):
        text = re.sub(r"<!--.*?-->", "", text, flags=re.S) if strip_comments else text
        self.lines, self.strip_comments, self.notes = text.splitlines(), strip_comments, notes
        self.blocks: list[dict] = []
        self.paragraph: list[str] = []
        self.pending: dict[str, str] = {}
        self.window = False

    def emit(self, kind: str, text: str = "", **more) -> None:
        self.flush()
        self.put(kind, text, **more)

    def put(self, kind: str, text: str = "", **more) -> None:
        if kind not in ("table", "table_caption") and self.pending:
            raise Problem("table.layout: no table follows")
        self.blocks.append({"kind": kind, "text": text, "level": 0, "cells": [], "language": "", "path": "", "options": {}, "alignments": []} | more)
        self.window = kind in ("table", "table_foot")

    def flush(self) -> None:
        joined = " ".join(p.strip() for p in self.paragraph).strip()
        self.paragraph = []
        if joined:
            self.put("paragraph", joined)

    def remember(self, found: dict[str, str]) -> None:
        for k, v in found.items():
            if self.pending.setdefault(k, v) != v:
                raise Problem(f"table.marker: {k} conflicts")

    def until(self, i: int, stop) -> tuple[list[str], int | None]:
        for j in range(i, len(self.lines)):
            if stop(self.lines[j].strip()):
                return self.lines[i:j], j
        return self.lines[i:], None

    def read(self) -> list[dict]:
        i = 0
        while i < len(self.lines):
            i = self.line(i)
        self.flush()
        if self.pending:
            raise Problem("table.layout: no table follows")
        return self.blocks

    def line(self, i: int) -> int:
        """Read what begins at line i; the next line to read. The order of the tests decides ambiguous lines."""
        raw = self.lines[i]
        s = raw.strip()
        if not s:
            self.flush()
        elif re.match(r"[!！](?:\s|$)", s):
            self.flush()
            if not self.strip_comments:
                self.emit("paragraph", f"[TODO: {s[1:].strip()}]")
        elif m := HEADING.match(s):
            self.emit("heading", m[2].strip(), level=len(m[1]))
        elif m := IMAGE.match(s):
            first, *rest = (p.strip() for p in m[1].strip().split("|"))
            pairs = [tuple(x.strip().lower() for x in p.split("=", 1)) for p in rest if "=" in p]
            self.emit("image", " | ".join([first, *(p for p in rest if "=" not in p)]), path=m[2].strip(), options=dict(pairs))
        elif s.startswith("```"):
            self.flush()
            body, end = self.until(i + 1, lambda x: x.startswith("```"))
            language = s[3:].strip()
            kind = FENCES.get(language.lower(), "code")
            if kind == "equation":
                self.emit(kind, " ".join(x.strip() for x in body))
            else:
                self.emit(kind, "\n".join(body), language=language)
            return len(self.lines) if end is None else end + 1
        elif s == "$$":
            self.flush()
            body, end = self.until(i + 1, lambda x: x == "$$")
            if end is None or not "".join(body).strip():
                raise Problem("equation.unclosed" if end is None else "equation.empty")
            self.emit("equation", "\n".join(body).strip())
            return end + 1
        elif starts_table(self.lines, i):
            return self.table(i)
        elif s.count("|") >= 2 and is_row(raw) and i + 1 < len(self.lines) and is_row(self.lines[i + 1]) and self.lines[i + 1].count("|") >= 2:
            raise Problem("table.separator")
        elif m := ORDERED.match(raw):
            self.emit("ordered", f"{m[2]}. {m[3]}", level=len(m[1]) // 2)
        elif m := BULLET.match(raw):
            self.emit("bullet", m[2], level=len(m[1]) // 2)
        elif s.startswith(">"):
            self.emit("quote", s.lstrip("> "))
        elif s in ("---", "***", "___"):
            self.emit("separator")
        elif REFERENCE.match(s):
            self.emit("reference", s)
        elif re.match(r"keywords\s*:", s, re.I):
            self.emit("keywords", s)
        elif ESCAPED.match(s):
            self.emit("paragraph", s[1:])
        elif m := NOTE.match(s):
            self.flush()
            body = m[1].strip()
            label = (LABEL.match(body) or ["", ""])[1].strip()
            if self.notes == "explicit" and not self.window:
                self.emit("paragraph", s, options={"table_note_orphan": "true", "label": label})
            else:
                self.emit("table_foot", body, options={"source": "directive", "label": label, "orphan": str(not self.window).lower()})
        elif self.notes == "legacy" and self.window and not self.paragraph and (m := LEGACY_NOTE.match(s)):
            self.emit("table_foot", s, options={"source": "legacy-bracket", "label": m[1]})
        elif m := LAYOUT.match(s):
            self.flush()
            key, value = m[1].lower(), m[2].lower()
            if value not in MARKERS[key]:
                raise Problem(f"table.marker: {key}={value}")
            self.remember({key: value})
        elif (m := NUMBERED.match(s)) and self.table_after(i + 1):
            self.caption(m[4].strip(), {"caption_label": m[1], "caption_punctuation": m[2], "caption_gap": m[3]})
        elif m := CAPTION.match(s):
            if AUTHORED.match(m[1].strip()):
                raise Problem("table.caption_ambiguous")
            self.caption(m[1].strip(), {})
        elif has_display(raw):
            raise Problem("equation.inline")
        else:
            self.paragraph.append(raw)
        return i + 1

    def table_after(self, i: int) -> bool:
        while i < len(self.lines) and not self.lines[i].strip():
            i += 1
        return starts_table(self.lines, i)

    def caption(self, text: str, options: dict[str, str]) -> None:
        self.flush()
        body, found = markers(text)
        self.remember(found)
        self.emit("table_caption", body, options=options | self.pending)

    def table(self, i: int) -> int:
        self.flush()
        header, rule = split_row(self.lines[i]), split_row(self.lines[i + 1])
        body, _ = self.until(i + 2, lambda x: not is_row(x))
        rows = [header, *map(split_row, body)]
        if any(len(r) != len(header) for r in (rule, *rows)):
            raise Problem("table.ragged")
        marks, self.pending = self.pending, {}
        self.emit("table", cells=rows, alignments=[alignment(c.strip()) for c in rule], options=marks)
        return i + 2 + len(body)


def parse(text: str | None, strip_comments: bool = True, notes: str = "legacy") -> list[dict]:
    """Block dicts of a text; a document that breaks a rule gives one error row after what came before."""
    reader = Reader(text or "", strip_comments, notes)
    try:
        return reader.read()
    except Problem as p:
        return [*reader.blocks, {"kind": "error", "error": str(p)}]


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, strip_comments: bool = True, notes: str = "legacy") -> DataFrame:
    """Rows of SCHEMA for each document. Only id and text cross to Python; nothing is shuffled."""
    if notes not in ("legacy", "explicit"):
        raise ValueError("notes must be legacy or explicit")

    def run(batches: Iterator):
        import pyarrow as pa

        types = {
            "doc_id": pa.int64(), "ordinal": pa.int32(), "kind": pa.string(), "text": pa.string(), "level": pa.int32(), "cells": pa.list_(pa.list_(pa.string())),
            "language": pa.string(), "path": pa.string(), "options": pa.map_(pa.string(), pa.string()), "alignments": pa.list_(pa.string()), "error": pa.string(),
        }
        for b in batches:
            rows = [{"doc_id": d, "ordinal": i} | x | {"options": list((x.get("options") or {}).items())} for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, x in enumerate(parse(t, strip_comments, notes))]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in types.items()], names=list(types))

    from ..functions.text import normalize_typography

    text = normalize_typography(F.regexp_replace(F.col(text_col), r"\r\n?", "\n"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, SCHEMA)
