"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases in the word
stream of a text; what follows a tag is read as a licence expression by a shunting-yard parser.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from .common import released

#: Upper case to lower case and every other ASCII sign to a space; bytes from 0x80 up stay.
WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))

#: Phrases of the base labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases, the label each stands for and how sure it is.
NOTICES = {
    "apache license": ("apache", 0.9),
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "bsd license": ("bsd", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "creative commons": ("cc", 0.8),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0": ("cc0", 0.9),
    "public domain": ("public-domain", 0.7),
    "do whatever the fuck you want": ("wtfpl", 0.9),
    "this is free and unencumbered software": ("unlicense", 0.9),
    "isc license": ("isc", 0.9),
    "proprietary and confidential": ("proprietary", 0.8),
}
TAG = "spdx license identifier"
TAGGED = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.I)
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: Identifiers that are bare words; all others hold a version or name a reference.
BARE = frozenset(
    """0bsd afl aladdin bcl beerware blessing bsd bsl cc0 curl ecos eudatagrid fair ftl gl2ps glide gnuplot hpnd ibm-pibs
    icu ijg imagemagick intel info-zip isc jasper json latex2e leptonica libpng libtiff linux-openib mit mit-0 mit-cmu
    mulanpsl naist-2003 ncsa ngpl nokia noweb ntp openssl plexus postgresql psutils qhull rsa-md ruby sax-pd
    sendmail sgi-b smlnj snia spencer-86 ssh-openssh sunpro tcl tcp-wrappers tmate unlicense vim vostrom w3c wtfpl x11 xerox xfig
    xinetd xpp zed zend zlib""".split()
)
#: Shapes of the other identifiers and of exceptions.
VERSIONED = re.compile(r"[a-z][a-z0-9]*(?:-[a-z0-9.]+)*-[0-9]+(?:\.[0-9]+)*[a-z]?(?:-[a-z0-9.]+)*\+?|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
EXCEPTION = re.compile(r"[a-z0-9][a-z0-9.-]*-(?:exception|note)(?:-[0-9.]+)?|additionref-[a-z0-9.-]+")
#: How strongly the operators bind.
BINDS = {"or": 1, "and": 2, "with": 3}
SCORES = {"cc-by": 0.8, "gpl": 0.9, "reserved": 0.5}


def is_licence(word: str) -> bool:
    return word.removesuffix("+") in BARE or VERSIONED.fullmatch(word) is not None


def parse_expression(text: str) -> tuple[list[str], list[str]] | None:
    """(licences, exceptions) that the expression at the start of text names, or None if it is none.

    Shunting-yard: operands go to the output and operators wait on a stack by how they bind. Only
    identifiers of the standard's list or shape are operands, as prose may stand behind an
    expression: it ends at the first token that cannot follow, and before an ``and``, ``or`` or
    ``with`` in small letters that joins nothing to it.
    """
    out: list[tuple] = []
    stack: list[str] = []
    tokens = [m[0] for m in TOKEN.finditer(text)]

    def apply() -> bool:
        op = stack.pop()
        if op == "(" or len(out) < 2:
            return False
        b, a = out.pop(), out.pop()
        if op == "with":
            if len(a[0]) != 1 or a[1] or b[0]:
                return False
            out.append((a[0], b[1]))
        else:
            if not a[0] or not b[0]:
                return False
            out.append((a[0] + b[0], a[1] + b[1]))
        return True

    def operand(k: int, after: str) -> bool:
        low = tokens[k].lower() if k < len(tokens) else ""
        return EXCEPTION.fullmatch(low) is not None if after == "with" else low == "(" or low not in BINDS and is_licence(low)

    wants, last = True, ""  # an operand, and what it stands behind
    for k, t in enumerate(tokens):
        low = t.lower()
        if low in BINDS and not wants:
            if not operand(k + 1, low):
                if t == low:  # prose
                    break
                return None
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[low]:
                if not apply():
                    return None
            stack.append(low)
            wants, last = True, low
        elif t == ")" and not wants:
            if "(" not in stack:
                break
            while stack[-1] != "(":
                if not apply():
                    return None
            stack.pop()
        elif not wants:
            break
        elif not operand(k, last):
            return None
        elif t == "(":
            stack.append(t)
            last = ""
        else:
            out.append(([], [low]) if last == "with" else ([low], []))
            wants = False
    if wants:
        return None
    while stack:
        if stack[-1] == "(" or not apply():
            return None
    return out[0] if len(out) == 1 and out[0][0] else None


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: None}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: str | None, find) -> dict:
    """What stands in one text; find: the automaton. The whole text is read."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    hits = [(end - len(p) - 1, p) for end, p in find.iter(line)]
    base = [(at, p) for at, p in hits if p in BASE]
    starts: list[int] = []
    if base:
        spaces = [m.start() for m in re.finditer(" ", line)]  # word k begins after space k
        starts = [bisect_right(spaces, at) - 1 for at, _ in base]
    base_labels = {BASE[p] for _, p in base}
    more = {NOTICES[p] for _, p in hits if p in NOTICES}
    sure = max([0.0, *(SCORES[x] for x in base_labels), *(s for _, s in more)])
    labels = base_labels | {x for x, _ in more}
    exprs = []
    if any(p == TAG for _, p in hits):
        for m in TAGGED.finditer(text or ""):
            if parsed := parse_expression(m[1]):
                exprs.append(m[1].strip())
                labels |= set(parsed[0]) | set(parsed[1])
                sure = 1.0
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": sure, "expressions": exprs,
    }


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: words, base phrases' places, labels, score and licence expressions.

    Places of a phrase may overlap those of another; all count. Row-local: no shuffle.
    Defined cases: null and empty texts have no words, no labels and score 0; malformed
    expressions name nothing; repeated rows repeat; other columns are not read; an empty table
    gives no rows.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"

    def run(batches):
        import pyarrow as pa

        find = automaton()
        types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "expressions": pa.list_(pa.string())}
        for b in batches:
            rows = [scan(t.as_py(), find) for t in b.column(1)]
            cols = [b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in list(types.items())[1:])]
            yield pa.RecordBatch.from_arrays(cols, names=list(types))
        released()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
