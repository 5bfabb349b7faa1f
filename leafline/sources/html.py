"""HTML tables to rectangular pipe tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE = re.compile(r"<table\b.*?</table>", re.I | re.S)
MARKS = {"em": "*", "i": "*", "strong": "**", "b": "**"}


class Grid(HTMLParser):
    """Cells of one table on a grid; spans repeat their text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict[int, str]] = []
        self.held: dict[int, tuple[str, int]] = {}
        self.cell: list[str] | None = None
        self.span = (1, 1)

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append({})
        elif tag in ("td", "th"):
            number = lambda k: max(1, int(v)) if (v := dict(attrs).get(k) or "1").isdigit() else 1
            self.cell, self.span = [], (number("rowspan"), number("colspan"))
        elif self.cell is not None:
            self.cell.append(MARKS.get(tag) or {"br": "<br>", "sub": "<sub>", "sup": "<sup>"}.get(tag, ""))

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.place(re.sub(r"(?:<br>\s*)+$", "", re.sub(r"\s+", " ", "".join(self.cell)).strip()).replace("|", r"\|"))
            self.cell = None
        elif tag == "tr" and self.rows:
            self.carry(self.rows[-1], 1 << 30)
        elif self.cell is not None:
            self.cell.append(MARKS.get(tag) or {"p": "<br>", "sub": "</sub>", "sup": "</sup>"}.get(tag, ""))

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def carry(self, row: dict[int, str], upto: int) -> None:
        for c in sorted(self.held):
            if c not in row and c <= upto:
                text, left = self.held.pop(c)
                row[c] = text
                if left > 1:
                    self.held[c] = (text, left - 1)

    def place(self, text: str) -> None:
        if not self.rows:
            self.rows.append({})
        row = self.rows[-1]
        c = 0
        while c in row or c in self.held:
            self.carry(row, c)
            c += 1
        down, across = self.span
        for k in range(c, c + across):
            row[k] = text
            if down > 1:
                self.held[k] = (text, down - 1)


def pipe_table(fragment: str) -> str:
    g = Grid()
    g.feed(fragment)
    g.close()
    width = max((max(r, default=-1) + 1 for r in g.rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join(r.get(c, "") for c in range(width)) + " |" for r in g.rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _piped(s: pd.Series) -> pd.Series:
    return s.map(lambda t: TABLE.sub(lambda m: pipe_table(m[0]), t or ""))


def tables_to_pipes(c) -> Column:
    """A text with each HTML table as a pipe table."""
    return F.pandas_udf(_piped, "string")(c)
