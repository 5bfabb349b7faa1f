"""TeX prose to styled spans: what a reader sees of a piece of TeX, and how it looks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relations are set with a blank on either side in math, other signs are not.
RELATIONS = {"approx": "≈", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "sim": "∼", "simeq": "≃", "equiv": "≡", "propto": "∝", "rightarrow": "→", "to": "→", "ll": "≪", "gg": "≫", "in": "∈"}
RELATION_SIGNS = frozenset("=<>") | frozenset(RELATIONS.values())
SIGNS = {"times": "×", "pm": "±", "cdot": "·", "degree": "°", "infty": "∞", "partial": "∂", "nabla": "∇", "sum": "∑", "int": "∫", "sqrt": "√", "ldots": "…", "dots": "…", "cdots": "⋯", "langle": "⟨", "rangle": "⟩", "prime": "′", "circ": "∘", "quad": "  ", "qquad": "    ", "textasciitilde": "~", "textbackslash": "\\", "S": "§"}
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
# Commands that set a style, that show one argument of several, and that show none.
STYLES = {"textbf": "bold", "mathbf": "bold", "textit": "italic", "emph": "italic", "mathit": "italic", "texttt": "mono", "textsuperscript": "sup", "textsubscript": "sub"}
SHOWN = {"href": (2, 1), "hyperlink": (2, 1), "hyperref": (1, 0), "texorpdfstring": (2, 0), "url": (1, 0), "mbox": (1, 0), "text": (1, 0), "textrm": (1, 0), "textnormal": (1, 0), "mathrm": (1, 0), "operatorname": (1, 0)}
HIDDEN = {"label": 1, "vspace": 1, "hspace": 1, "bookmark": 1, "end": 1, "setcounter": 2, "refstepcounter": 1, "includegraphics": 1}
SECOND_ARGUMENT = {"minipage", "tabular", "adjustbox"}
REFERENCES = {"ref": False, "eqref": False, "autoref": True, "Autoref": True, "cref": True, "Cref": True}
KINDS = {"fig": "Figure", "figure": "Figure", "tab": "Table", "table": "Table", "alg": "Algorithm", "algorithm": "Algorithm", "eq": "Equation", "equation": "Equation", "section": "Section", "subsection": "Section"}
EXTENDED = {"Figure": "Extended Data Fig.", "Table": "Extended Data Table"}
LITERAL = {"%": "%", "&": "&", "#": "#", "_": "_", "{": "{", "}": "}", "$": "$", " ": " ", ",": "\u2009", ";": " ", ":": " ", "!": "", "/": "", "-": ""}
NAME = re.compile(r"[A-Za-z]+\*?")
BREAK = re.compile(r"\\\\\*?\s*(?:\[[^\]]*\])?\s*")
MARKS = ((r"---", "—"), (r"--", "–"), (r"``", "“"), (r"''", "”"), (r"`", "‘"), (r"'", "’"), (r"~", "\u00a0"))


def _greek() -> dict[str, str]:
    said = {"lambda": "LAMDA"}
    out = {}
    for name in GREEK:
        out[name] = unicodedata.lookup(f"GREEK SMALL LETTER {said.get(name, name.upper())}")
        out[name.capitalize()] = unicodedata.lookup(f"GREEK CAPITAL LETTER {said.get(name, name.upper())}")
    return out


LETTERS = _greek()


class Style(NamedTuple):
    bold: bool = False
    italic: bool = False
    sup: bool = False
    sub: bool = False
    mono: bool = False
    color: str = ""
    highlight: str = ""


class Reader:
    """One walk over a text; ``resolve`` gives a label's number, ``kind`` its kind where a prefix does not tell it."""

    def __init__(self, text: str, resolve: Callable[[str], str | None] | None, kind: Callable[[str], str | None] | None):
        self.s, self.at, self.out = text, 0, []
        self.resolve, self.kind = resolve or (lambda key: None), kind or (lambda key: None)

    def put(self, text: str, style: Style) -> None:
        if not text:
            return
        apart = text.strip() in RELATION_SIGNS or self.out and self.out[-1][0].strip() in RELATION_SIGNS
        if self.out and self.out[-1][1] == style and not apart:
            self.out[-1] = (self.out[-1][0] + text, style)
        else:
            self.out.append((text, style))

    def argument(self) -> str:
        """What the next group holds, or the next sign; empty at the end."""
        while self.at < len(self.s) and self.s[self.at] in " \t\n":
            self.at += 1
        if self.at >= len(self.s):
            return ""
        if self.s[self.at] != "{":
            m = re.compile(r"\\(?:[A-Za-z]+|.)|.", re.S).match(self.s, self.at)
            self.at = m.end()
            return m[0]
        depth, begin = 0, self.at + 1
        while self.at < len(self.s):
            c = self.s[self.at]
            if c == "\\":
                self.at += 1
            depth += (c == "{") - (c == "}")
            self.at += 1
            if depth == 0:
                return self.s[begin : self.at - 1]
        return self.s[begin:]

    def option(self) -> None:
        if self.s.startswith("[", self.at) and (end := self.s.find("]", self.at)) >= 0:
            self.at = end + 1

    def inside(self, text: str, style: Style, math: bool) -> None:
        part = Reader(text, self.resolve, self.kind)
        part.walk(style, math)
        for t, s in part.out:
            self.put(t, s)

    def reference(self, named: bool) -> str:
        shown = []
        for key in filter(None, (k.strip() for k in self.argument().split(","))):
            value = self.resolve(key) or key
            prefix, _, rest = key.lower().removeprefix("s-").partition(":")
            kind = self.kind(key)
            kind = KINDS.get(kind, kind) if kind else KINDS.get(prefix) if rest else None
            if rest.startswith("ed_"):
                kind = EXTENDED.get(kind, kind)
            shown.append(f"{kind} {value}" if named and kind else value)
        return (", " if named else ",").join(shown)

    def command(self, style: Style, math: bool) -> None:
        self.at += 1
        m = NAME.match(self.s, self.at)
        if m is None:
            c = self.s[self.at : self.at + 1]
            if c == "\\":
                self.at = BREAK.match(self.s, self.at - 1).end()
                self.put(" ", style)
            elif c in "([":
                end = self.s.find("\\" + ")]"["([".index(c)], self.at + 1) if c else -1
                body = self.s[self.at + 1 : end if end >= 0 else len(self.s)]
                self.at = end + 2 if end >= 0 else len(self.s)
                self.inside(body, style, True)
            else:
                self.at += 1
                self.put(LITERAL.get(c, c), style)
            return
        name, self.at = m[0].rstrip("*"), m.end()
        if name in STYLES:
            self.inside(self.argument(), style._replace(**{STYLES[name]: True}), math)
        elif name in ("highlight", "hl"):
            self.option()
            self.inside(self.argument(), style._replace(highlight="yellow"), math)
        elif name == "textcolor":
            color = self.argument()
            self.inside(self.argument(), style._replace(color=color), math)
        elif name in SHOWN:
            self.option()
            many, shown = SHOWN[name]
            held = [self.argument() for _ in range(many)]
            self.inside(held[shown], style._replace(italic=style.italic), False)
        elif name in REFERENCES:
            self.put(self.reference(REFERENCES[name]), style)
        elif name in ("frac", "dfrac", "tfrac"):
            top, low = self.argument(), self.argument()
            self.inside(top, style, True)
            self.put("/", style)
            self.inside(low, style, True)
        elif name == "bar":
            self.inside("".join(c + "\u0305" for c in re.sub(r"\\mathbf\s*", "", self.argument())), style, math)
        elif name == "begin":
            env = self.argument()
            self.option()
            if env.rstrip("*") in SECOND_ARGUMENT:
                self.argument()
        elif name in HIDDEN:
            self.option()
            for _ in range(HIDDEN[name]):
                self.argument()
        elif name in RELATIONS:
            self.blanks()
            self.put(f" {RELATIONS[name]} " if math else RELATIONS[name], style)
        elif name in LETTERS:
            self.blanks()
            self.put(LETTERS[name], style._replace(italic=math and name != "Delta" or style.italic))
            if not math and m.end() < len(self.s) and self.s[m.end()] == " ":
                self.put(" ", style)
        elif name in SIGNS:
            self.put(SIGNS[name], style)
        else:  # a command without a meaning here: what it sets follows
            self.blanks()

    def blanks(self) -> None:
        while self.at < len(self.s) and self.s[self.at] in " \t":
            self.at += 1

    def walk(self, style: Style = Style(), math: bool = False) -> list[tuple[str, Style]]:
        s = self.s
        while self.at < len(s):
            c = s[self.at]
            if c == "\\":
                self.command(style, math)
            elif c == "%":
                end = s.find("\n", self.at)
                self.at = len(s) if end < 0 else end
            elif c == "$":
                mark = "$$" if s.startswith("$$", self.at) else "$"
                end = s.find(mark, self.at + len(mark))
                body = s[self.at + len(mark) : end if end >= 0 else len(s)]
                self.at = end + len(mark) if end >= 0 else len(s)
                self.inside(body, style, True)
            elif c == "{":
                self.inside(self.argument(), style, math)
            elif c == "}":
                self.at += 1
            elif c in "^_" and math:
                self.at += 1
                self.inside(self.argument(), style._replace(**{"sup" if c == "^" else "sub": True}), True)
            elif math:
                self.at += 1
                if c in RELATION_SIGNS:
                    self.put(f" {c} ", style)
                elif c not in " \t\n&":
                    self.put("–" if c == "-" else c, style._replace(italic=style.italic or c.isalpha() and c != "Δ"))
            else:
                mark, shown = next(((m, t) for m, t in MARKS if s.startswith(m, self.at)), (c, c))
                self.at += len(mark)
                self.put(shown, style)
        return self.out


def tighten(spans: list[tuple[str, Style]]) -> list[tuple[str, Style]]:
    """A relation that is a math group of its own stands between prose blanks already: one is enough."""
    out: list[tuple[str, Style]] = []
    for k, (text, style) in enumerate(spans):
        core = text.strip()
        if core in RELATION_SIGNS and text == f" {core} ":
            before, after = spans[k - 1][0] if k else " ", spans[k + 1][0] if k + 1 < len(spans) else " "
            text = ("" if before.endswith((" ", "\n")) else " ") + core + ("" if after.startswith((" ", "\n")) else " ")
        out.append((text, style))
    return out


def tokenize(text: str | None, resolve: Callable | None = None, kind: Callable | None = None) -> list[tuple[str, Style]]:
    """(text, style) spans of TeX prose."""
    return tighten(Reader(text or "", resolve, kind).walk())


def plain(text: str | None, resolve: Callable | None = None, kind: Callable | None = None) -> str:
    return "".join(t for t, _ in tokenize(text, resolve, kind))


def spans(docs: DataFrame, labels: Column | None = None, kinds: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ordinal, text and the style of each span. labels, kinds: maps from a label to its number and kind, on the row."""
    none = F.lit(None).cast("map<string,string>")
    schema = "array<struct<text:string,bold:boolean,italic:boolean,sup:boolean,sub:boolean,mono:boolean,color:string,highlight:string>>"

    @F.pandas_udf(schema)
    def read(texts, numbers, named):
        import pandas as pd

        get = lambda m: dict(m).get if m is not None else None
        return pd.Series([[{"text": x, **s._asdict()} for x, s in tokenize(t, get(n), get(k))] for t, n, k in zip(texts, numbers, named)])

    found = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(read(F.col(text_col), none if labels is None else labels, none if kinds is None else kinds)).alias("ordinal", "x"))
    return found.select("doc_id", "ordinal", "x.*")


def visible_counters(lines: DataFrame, counters: tuple[str, ...] = ("suppnote", "suppfigure", "supptable")) -> DataFrame:
    """Lines with ``\\the<counter>`` as the number that ``\\refstepcounter`` has reached by then: running counts of a document.

    lines: (doc_id, line_no, raw).
    """
    from pyspark.sql import Window

    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    raw = F.col("raw")
    for c in counters:
        step = F.size(F.regexp_extract_all("raw", F.lit(rf"\\(?:ref)?stepcounter\{{{c}\}}"), F.lit(0)))
        lines = lines.withColumn(f"n_{c}", F.sum(step).over(upto))
        raw = F.regexp_replace(raw, F.lit(rf"\\the{c}(?![A-Za-z])"), F.col(f"n_{c}").cast("string"))
        raw = F.regexp_replace(raw, rf"\\(?:ref)?stepcounter\{{{c}\}}", "")
    return lines.withColumn("raw", raw).drop(*(f"n_{c}" for c in counters))
