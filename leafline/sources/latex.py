"""TeX sources to block rows and plain text, and the labels that counters give."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

SCHEMA = "doc_id long, ordinal int, kind string, text string, level int, cells array<array<string>>, label string, code string"
# Environments and the kind of block each is; headings and their levels.
ENVIRONMENTS = {
    "itemize": "bullet", "enumerate": "ordered", "quote": "quote", "quotation": "quote", "equation": "equation", "equation*": "equation", "align": "equation", "align*": "equation",
    "displaymath": "equation", "gather": "equation", "gather*": "equation", "verbatim": "code", "lstlisting": "code", "tabular": "table", "figure": "image", "figure*": "image", "table": "float", "table*": "float", "abstract": "abstract",
}
HEADINGS = {"section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
# Accents and signs that plain text shows as they are.
SIGNS = {r"\&": "&", r"\%": "%", r"\$": "$", r"\#": "#", r"\_": "_", r"\{": "{", r"\}": "}", "~": "\u00a0", "---": "\u2014", "--": "\u2013", "``": "\u201c", "''": "\u201d", r"\ldots": "…", r"\dots": "…", r"\times": "×", r"\pm": "±", r"\cdot": "·", r"\degree": "°", r"\alpha": "α", r"\beta": "β", r"\gamma": "γ", r"\delta": "δ", r"\mu": "μ", r"\textbackslash": "\\"}
COMMENT = re.compile(r"(?m)(?<!\\)((?:\\\\)*)%.*$")
BEGIN = re.compile(r"\\begin\{([A-Za-z]+\*?)\}(?:\[[^\]]*\])?")
HEAD = re.compile(r"\\(section|subsection|subsubsection|paragraph|subparagraph)\*?\{")
DISPLAY = re.compile(r"\\\[(.*?)\\\]|\$\$(.*?)\$\$", re.S)
KEEPS = re.compile(r"\\(?:textbf|textit|emph|texttt|textsc|textrm|mathrm|mathbf|underline|text|mbox|caption|title)\*?\{([^{}]*)\}")
DROPS = re.compile(r"\\(?:cite\w*|ref|eqref|label|pageref|autoref)\*?(?:\[[^\]]*\])?\{[^{}]*\}")
LABEL = re.compile(r"\\label\{([^}]+)\}")


def group(text: str, at: int) -> tuple[str, int]:
    """The content of the brace group whose opening brace is before ``at``, and what follows it."""
    depth = 1
    for m in re.finditer(r"\\.|[{}]", text[at:], re.S):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return text[at : at + m.start()], at + m.end()
    return text[at:], len(text)


def body_of(text: str, at: int, name: str) -> tuple[str, int, bool]:
    """An environment's body with inner ones of its name counted; False if it never ends."""
    depth = 1
    for m in re.finditer(rf"\\(begin|end)\{{{re.escape(name)}\}}", text[at:]):
        depth += 1 if m[1] == "begin" else -1
        if not depth:
            return text[at : at + m.start()], at + m.end(), True
    return text[at:], len(text), False


def plain(tex: str | None) -> str:
    """Visible text of TeX prose: commands' arguments, signs, no references."""
    t = COMMENT.sub(r"\1", tex or "")
    t = DROPS.sub("", t)
    while (new := KEEPS.sub(r"\1", t)) != t:
        t = new
    names = sorted(SIGNS, key=len, reverse=True)
    t = re.sub("|".join(re.escape(n) + ("(?![A-Za-z])" if n[-1].isalpha() else "") for n in names), lambda m: SIGNS[m[0]], t)
    t = re.sub(r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?", "", t)
    return re.sub(r"[ \t\n]+", " ", re.sub(r"[{}$]", "", t)).strip()


def parse(tex: str | None) -> list[dict]:
    text = COMMENT.sub(r"\1", tex or "")
    if m := re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", text, re.S):
        text = m[1]
    out: list[dict] = []
    prose: list[str] = []

    def put(kind: str, body: str = "", **more) -> None:
        out.append({"kind": kind, "text": body, "level": 0, "cells": [], "label": None, "code": None} | more)

    def flush() -> None:
        for p in re.split(r"\n\s*\n", "".join(prose)):
            label = (LABEL.search(p) or [None, None])[1]
            if body := plain(p):
                put("paragraph", body, label=label)
        prose.clear()

    at = 0
    marks = re.compile(f"{BEGIN.pattern}|{HEAD.pattern}|{DISPLAY.pattern}", re.S)
    while m := marks.search(text, at):
        prose.append(text[at : m.start()])
        flush()
        at = m.end()
        if m[2]:
            title, at = group(text, at)
            put("heading", plain(title), level=HEADINGS[m[2]])
        elif m[1]:
            body, at, closed = body_of(text, at, m[1])
            environment(m[1], body, put)
            if not closed:
                put("error", m[1], code="latex.unclosed_environment")
        else:
            put("equation", (m[3] or m[4] or "").strip())
    prose.append(text[at:])
    flush()
    return out


def rows_of(body: str) -> list[list[str]]:
    body = re.sub(r"^\s*(?:\[[^\]]*\])?\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", body)
    body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", body)
    rows = [[plain(c) for c in re.split(r"(?<!\\)&", r)] for r in re.split(r"\\\\(?:\[[^\]]*\])?", body)]
    return [r for r in rows if any(r)]


def environment(name: str, body: str, put) -> None:
    kind, label = ENVIRONMENTS.get(name), (LABEL.search(body) or [None, None])[1]
    if kind in ("bullet", "ordered"):
        for k, item in enumerate(re.split(r"\\item(?![A-Za-z])(?:\[[^\]]*\])?", body)[1:], 1):
            put(kind, (f"{k}. " if kind == "ordered" else "") + plain(item))
    elif kind == "equation":
        inner = LABEL.sub("", body).strip()
        put(kind, inner if name in ("equation", "equation*", "displaymath") else f"\\begin{{{name}}}\n{inner}\n\\end{{{name}}}", label=label)
    elif kind == "code":
        put(kind, body.strip("\n"))
    elif kind == "table":
        put(kind, cells=rows_of(body), label=label)
    elif kind in ("image", "float"):
        caption = ""
        if c := re.search(r"\\caption(?:\[[^\]]*\])?\{", body):
            caption = plain(group(body, c.end())[0])
        if kind == "image":
            path = re.search(r"\\includegraphics(?:\[[^\]]*\])?\{([^}]+)\}", body)
            put("image", caption, label=label, code=None if path else "resource.missing")
        else:
            put("table_caption", caption, label=label)
            if t := BEGIN.search(body):
                put("table", cells=rows_of(body_of(body, t.end(), t[1])[0]), label=label)
    elif kind in ("quote", "abstract"):
        put("quote" if kind == "quote" else "paragraph", plain(body), label=label)
    else:
        put("opaque", body.strip(), label=label, code="latex.unsupported_environment")


def label_numbers(tex: str | None, prefix: str = "") -> list[tuple[str, str, str]]:
    """(label, kind, number) by the counters of sections, figures, tables, algorithms and equations."""
    text = COMMENT.sub(r"\1", tex or "")
    counts = {"section": 0, "subsection": 0, "figure": 0, "table": 0, "algorithm": 0, "equation": 0}
    scope: list[tuple[str, str]] = []
    current, out = ("section", ""), []
    pattern = re.compile(r"\\(begin|end)\{(figure|table|algorithm|equation|align|gather)(\*?)\}|\\(section|subsection)(\*?)\{|\\label\{([^}]+)\}|\\caption\b")
    for m in pattern.finditer(text):
        if m[4]:
            if not m[5]:
                counts[m[4]] += 1
                if m[4] == "section":
                    counts["subsection"] = 0
                number = f"{counts['section']}.{counts['subsection']}" if m[4] == "subsection" else str(counts["section"])
                current = (m[4], prefix + number)
        elif m[1] == "begin":
            kind = m[2] if m[2] in ("figure", "table", "algorithm") else "equation"
            numbered = kind in ("figure", "table", "algorithm") or not m[3]
            if numbered:
                counts[kind] += 1
            scope.append((kind, prefix + str(counts[kind]) if numbered else ""))
        elif m[1] == "end":
            if scope:
                scope.pop()
        elif m[6]:
            kind, number = scope[-1] if scope else current
            if number:
                out.append((m[6].strip(), kind, number))
    return out


def _mapped(docs: DataFrame, id_col: str, text_col: str, schema: str, names: list[str], one) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
        kinds = [types[c.split()[1]] for c in schema.split(", ")]
        for b in batches:
            rows = [(d, *r) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in one(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SCHEMA; what cannot be represented carries a code."""
    return _mapped(docs, id_col, text_col, SCHEMA, [c.split()[0] for c in SCHEMA.split(", ")], lambda t: [(i, x["kind"], x["text"], x["level"], x["cells"], x["label"], x["code"]) for i, x in enumerate(parse(t))])


def labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """doc_id, label, kind, value of each label that a counter numbers."""
    return _mapped(docs, id_col, text_col, "doc_id long, label string, kind string, value string", ["doc_id", "label", "kind", "value"], lambda t: label_numbers(t, prefix))


def plain_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _mapped(docs, id_col, text_col, "doc_id long, text string", ["doc_id", "text"], lambda t: [(plain(t),)])


def expand_inputs(files: DataFrame) -> DataFrame:
    """doc_id, depth, file: every file that a document's \\input and \\include reach, however deep; a file counts once.

    files: (doc_id, name, text). Joins along include edges, one a level; files that were reached
    before go no further, so loops end.
    """
    inputs = F.regexp_extract_all(F.regexp_replace("text", r"(?m)(?<!\\)%.*$", ""), F.lit(r"\\(?:input|include)\{([^}]+)\}"), F.lit(1))
    named = files.select("doc_id", "name", F.explode(inputs).alias("to"))
    edges = named.select("doc_id", "name", F.when(F.col("to").endswith(".tex"), F.col("to")).otherwise(F.concat("to", F.lit(".tex"))).alias("to")).distinct()
    edges = cut(edges)
    roots = files.select("doc_id", "name").join(edges.select("doc_id", F.col("to").alias("name")), ["doc_id", "name"], "left_anti")
    out = step = cut(roots.select("doc_id", F.lit(0).alias("depth"), F.col("name").alias("file")).distinct())
    depth = 0
    while step.limit(1).count():
        depth += 1
        found = step.select("doc_id", "file").join(edges.withColumnRenamed("name", "file"), ["doc_id", "file"]).select("doc_id", F.col("to").alias("file")).distinct()
        step = cut(found.join(out.select("doc_id", "file"), ["doc_id", "file"], "left_anti").select("doc_id", F.lit(depth).alias("depth"), "file"))
        out = cut(out.unionByName(step))
    return out.select("doc_id", "file", "depth")
