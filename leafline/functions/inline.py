"""Inline Markdown and TeX: runs, node trees and matching keys, behind Arrow UDFs."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inline constructs by precedence; the name of the group that matched is the node's kind.
MARKDOWN = re.compile(
    r"(?P<escape>\\[\\`*{}\[\]()#+\-.!_>~|<%$&=:?@])|\\citep?\{(?P<citation>[^{}]+)\}|\\label\{(?P<label>[^{}]+)\}|\\(?:eq)?ref\{(?P<reference>[^{}]+)\}"
    r"|(?P<ticks>`+)(?P<code>.+?)(?P=ticks)(?!`)|(?<!\$)\$(?P<math>[^$\n]+)\$(?!\$)|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)]+)\)|\[(?P<link>[^\]]+)\]\((?P<href>[^)]+)\)"
    r"|\*\*(?P<strong>.+?)\*\*(?!\*)|\*(?P<emph>[^*\n]+?)\*|<(?P<tag>sub|sup|u)>(?P<tagged>.*?)</(?P=tag)>|(?P<break><br\s*/?>)",
    re.I | re.S,
)
LATEX = {"textbf": "strong", "emph": "emph", "textit": "emph", "textsubscript": "sub", "textsuperscript": "sup", "underline": "underline", "texttt": "code"}
LATEX_MARK = re.compile(r"\\cite[pt]?\{(?P<citation>[^{}]+)\}|\\label\{(?P<label>[^{}]+)\}|\\(?:eq)?ref\{(?P<reference>[^{}]+)\}|\$(?P<math>[^$]+)\$|\\href\{(?P<href>[^{}]*)\}\{(?P<link>[^{}]*)\}|\\(?P<command>[A-Za-z]+)\*?\{|\\(?P<escape>[&%$#_{}])")
LIST_NUMBER = re.compile(r"^\s*(?:\(?\d+[.)]|\[\d+\])\s+")


def nodes(text: str | None) -> list[dict]:
    """Pre-order nodes (kind, text, depth, attrs) of inline Markdown."""
    out: list[dict] = []

    def walk(s: str, depth: int) -> None:
        at = 0
        for m in MARKDOWN.finditer(s):
            add(s[at : m.start()], depth)
            at = m.end()
            g = m.groupdict()
            if g["escape"]:
                add(g["escape"][1], depth)
            elif g["citation"] or g["label"] or g["reference"]:
                kind = next(k for k in ("citation", "label", "reference") if g[k])
                keys = [k.strip() for k in g[kind].split(",") if k.strip()]
                out.append({"kind": kind, "text": "", "depth": depth, "attrs": {"keys": ",".join(keys)}})
            elif g["code"]:
                out.append({"kind": "code", "text": g["code"], "depth": depth, "attrs": {}})
            elif g["math"]:
                out.append({"kind": "math", "text": g["math"], "depth": depth, "attrs": {}})
            elif g["src"]:
                out.append({"kind": "image", "text": g["alt"], "depth": depth, "attrs": {"path": g["src"]}})
            elif g["break"]:
                out.append({"kind": "break", "text": "", "depth": depth, "attrs": {}})
            else:
                inner = g["link"] or g["strong"] or g["emph"] or g["tagged"] or ""
                kind = "link" if g["link"] else "strong" if g["strong"] else "emph" if g["emph"] else {"u": "underline"}.get(g["tag"].lower(), g["tag"].lower())
                out.append({"kind": kind, "text": "", "depth": depth, "attrs": {"target": g["href"]} if g["link"] else {}})
                walk(inner, depth + 1)
        add(s[at:], depth)

    def add(s: str, depth: int) -> None:
        if s:
            if out and out[-1]["kind"] == "text" and out[-1]["depth"] == depth:
                out[-1]["text"] += s
            else:
                out.append({"kind": "text", "text": s, "depth": depth, "attrs": {}})

    walk(re.sub(r"(?<![\\\w])_([^_\n]+?)_(?!\w)", r"*\1*", re.sub(r"(?<![\\\w])__([^_\n]+?)__(?!\w)", r"**\1**", text or "")), 0)
    return out


def latex_nodes(text: str | None) -> list[dict]:
    """Pre-order nodes of inline TeX; an unknown command keeps its argument and is reported in attrs."""
    out: list[dict] = []

    def add(s: str, depth: int) -> None:
        if s:
            if out and out[-1]["kind"] == "text" and out[-1]["depth"] == depth:
                out[-1]["text"] += s
            else:
                out.append({"kind": "text", "text": s, "depth": depth, "attrs": {}})

    def walk(s: str, depth: int) -> None:
        at = 0
        while m := LATEX_MARK.search(s, at):
            add(s[at : m.start()], depth)
            at, g = m.end(), m.groupdict()
            if g["command"]:
                level, end = 1, at
                for b in re.finditer(r"\\.|[{}]", s[at:], re.S):
                    level += {"{": 1, "}": -1}.get(b[0], 0)
                    if not level:
                        end = at + b.start()
                        break
                else:
                    end = len(s)
                kind = LATEX.get(g["command"])
                out.append({"kind": kind or "unknown", "text": "", "depth": depth, "attrs": {} if kind else {"command": g["command"]}})
                walk(s[at:end], depth + 1)
                at = min(end + 1, len(s))
            elif g["escape"]:
                add(g["escape"], depth)
            elif g["link"] is not None:
                out.append({"kind": "link", "text": "", "depth": depth, "attrs": {"target": g["href"]}})
                walk(g["link"], depth + 1)
            else:
                kind = next(k for k in ("citation", "label", "reference", "math") if g[k])
                out.append({"kind": kind, "text": g[kind] if kind == "math" else "", "depth": depth, "attrs": {} if kind == "math" else {"keys": ",".join(k.strip() for k in g[kind].split(","))}})
        add(s[at:], depth)

    walk(text or "", 0)
    return out


def _close(stack: list, depth: int, ends: dict) -> str:
    out = ""
    while stack and stack[-1][0] >= depth:
        out += ends[stack.pop()[1]]
    return out


def write_markdown(tree: list[dict]) -> str:
    """Inline Markdown of nodes; parsing it again gives the same nodes."""
    begins = {"strong": "**", "emph": "*", "sub": "<sub>", "sup": "<sup>", "underline": "<u>", "link": "[", "unknown": ""}
    out, stack = "", []
    for n in tree:
        ends = {"strong": "**", "emph": "*", "sub": "</sub>", "sup": "</sup>", "underline": "</u>", "unknown": ""} | {k: k[4:] for _, k in stack if k.startswith("link")}
        out += _close(stack, n["depth"], ends)
        k = n["kind"]
        if k in begins:
            out += begins[k]
            stack.append((n["depth"], f"link]({n['attrs'].get('target', '')})" if k == "link" else k))
        elif k == "text":
            out += re.sub(r"([\\`*\[\]$])", r"\\\1", n["text"])
        elif k in ("citation", "label", "reference"):
            out += f"\\{ {'citation': 'cite', 'label': 'label', 'reference': 'ref'}[k] }{{{n['attrs']['keys']}}}"
        elif k == "break":
            out += "<br>"
        else:
            out += {"code": f"`{n['text']}`", "math": f"${n['text']}$", "image": f"![{n['text']}]({n['attrs'].get('path', '')})"}[k]
    return out + _close(stack, 0, {"strong": "**", "emph": "*", "sub": "</sub>", "sup": "</sup>", "underline": "</u>", "unknown": ""} | {k: k[4:] for _, k in stack if k.startswith("link")})


def write_latex(tree: list[dict]) -> str:
    """Inline TeX of nodes."""
    begins = {v: f"\\{k}{{" for k, v in reversed(LATEX.items()) if v != "code"}
    out, stack = "", []
    for n in tree:
        ends = {k: "}" for _, k in stack}
        out += _close(stack, n["depth"], ends)
        k = n["kind"]
        if k in begins or k in ("link", "unknown"):
            out += begins.get(k) or (f"\\href{{{n['attrs'].get('target', '')}}}{{" if k == "link" else "{")
            stack.append((n["depth"], k))
        elif k == "text":
            out += re.sub(r"([&%$#_{}])", r"\\\1", n["text"])
        elif k in ("citation", "label", "reference"):
            out += f"\\{ {'citation': 'cite', 'label': 'label', 'reference': 'ref'}[k] }{{{n['attrs']['keys']}}}"
        else:
            out += {"code": f"\\texttt{{{n['text']}}}", "math": f"${n['text']}$", "image": f"\\includegraphics{{{n['attrs'].get('path', '')}}}", "break": r"\\"}[k]
    return out + _close(stack, 0, {k: "}" for _, k in stack})


def runs(text: str | None) -> list[dict]:
    """Visible runs with their marks; equal neighbours are one."""
    out: list[dict] = []
    stack: list[tuple[int, str]] = []
    for n in nodes(text):
        while stack and stack[-1][0] >= n["depth"]:
            stack.pop()
        k = n["kind"]
        if k in ("strong", "emph", "sub", "sup", "underline", "link"):
            stack.append((n["depth"], k))
            continue
        shown = n["text"] if k in ("text", "code", "math", "image") else ""
        on = {x for _, x in stack} | ({k} if k == "code" else set())
        run = {"text": html.unescape(shown) if k == "text" else shown, "bold": "strong" in on, "italic": "emph" in on, "sub": "sub" in on, "sup": "sup" in on, "code": "code" in on}
        if not run["text"]:
            continue
        if out and all(out[-1][x] == run[x] for x in run if x != "text"):
            out[-1]["text"] += run["text"]
        else:
            out.append(run)
    return out


def key(text: str | None, strip_number: bool = True) -> str:
    """What two spellings of one line have in common."""
    value = unicodedata.normalize("NFKC", "".join(r["text"] for r in runs(text)))
    value = "".join("-" if c == "\u2212" or unicodedata.category(c) == "Pd" else c for c in value)
    value = re.sub(r"\s+", " ", value).strip()
    return LIST_NUMBER.sub("", value) if strip_number else value


def _each(one, kind: str):
    """A pandas UDF that maps one function over a column."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in s], dtype=object)

    return F.pandas_udf(run, kind)


def inline_key(c) -> Column:
    return _each(key, "string")(c)


def display_runs(c) -> Column:
    return _each(runs, "array<struct<text:string,bold:boolean,italic:boolean,sub:boolean,sup:boolean,code:boolean>>")(c)


def composed(text: str | None) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text or "")).strip()


def nfc(c) -> Column:
    """Composed form with single blanks."""
    return _each(composed, "string")(c)


def inline_nodes(rows: DataFrame, ids: list[str], text_col: str = "text", syntax: str = "markdown") -> DataFrame:
    """ids, node, kind, text, depth, attrs: inline trees as pre-order rows; a subtree is a range of nodes."""
    tree = _each(nodes if syntax == "markdown" else latex_nodes, "array<struct<kind:string,text:string,depth:int,attrs:map<string,string>>>")
    return rows.select(*ids, F.posexplode(tree(F.col(text_col))).alias("node", "n")).select(*ids, "node", "n.kind", "n.text", "n.depth", "n.attrs")


def citation_keys(tree: DataFrame, ids: list[str]) -> DataFrame:
    """ids, key, position: citations of inline trees in reading order."""
    return tree.where("kind = 'citation'").select(*ids, F.col("node").alias("position"), F.explode(F.split(F.col("attrs")["keys"], ",")).alias("key"))
