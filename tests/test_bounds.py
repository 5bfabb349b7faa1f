"""What once had a bound: beyond it, results are whole. And alignments against plain definitions."""

import random
import statistics
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.operators import aggregates as A
from leafline.operators import align as L
from leafline.operators import blocks as B
from leafline.operators import delta as D
from leafline.operators import lines as N
from leafline.plans import pipeline as P
from leafline.sources import latex, markdown


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_an_error_behind_many_warnings_fails_the_run(spark):
    r = P.Registry()
    severity = F.when(F.col("id") == 19_999, "error").otherwise("warning")
    r.add("gate", "many", lambda arts, p: arts["docs"].select(severity.alias("severity"), F.lit("gate.many").alias("code"), F.col("id").cast("string").alias("subject")))
    got = P.Runner(r).run(spark, P.Spec((), ({"id": "g", "kind": "many"},)), {"docs": spark.range(20_000)})
    assert got.status == "fail" and got.findings["gate:g"].count() == 20_000
    assert {(d["severity"], d["count"]) for d in got.diagnostics} == {("error", 1), ("warning", 19_999)}


def test_a_stage_key_follows_from_what_it_reads(spark):
    r = P.Registry()
    r.add("stage", "pass", lambda inputs, p: {"out": next(iter(inputs.values()))})
    spec = P.Spec((P.Stage("a", "pass", consumes=("docs",), produces=("out",)), P.Stage("b", "pass", ("a",), ("out",), ("last",))))
    spec = P.Spec((spec.stages[0], P.Stage("b", "pass", ("a",), ("out",))))
    keys = lambda rows: [s["key"] for s in P.Runner(r).run(spark, spec, {"docs": spark.createDataFrame(rows, "i long, t string")}).manifest["stages"]]
    one = keys([(1, "a"), (2, None)])
    assert one == keys([(2, None), (1, "a")]) and not set(one) & set(keys([(1, "a"), (2, "")]))


def test_long_chains_and_loops_of_styles(spark):
    rows = [(f"s{i}", f"s{i + 1}" if i < 60 else None) for i in range(61)] + [("x", "y"), ("y", "x")]
    got = {(r.style, r.ancestor): r.depth for r in A.inherited(spark.createDataFrame(rows, "style string, based_on string")).collect()}
    assert got["s0", "s60"] == 60 and len(got) == 61 * 62 // 2 + 4 and got["x", "y"] == 1 and got["x", "x"] == 0


def test_deep_includes(spark):
    files = spark.createDataFrame([(1, f"f{i}.tex", f"\\input{{f{i + 1}}}") for i in range(25)] + [(1, "f25.tex", "\\input{f3}")], "doc_id long, name string, text string")
    assert {r.file: r.depth for r in latex.expand_inputs(files).collect()} == {f"f{i}.tex": i for i in range(26)}


@pytest.mark.parametrize("n", [0, 1, 2, 9, 40])
def test_adjacent_parentheticals(spark, n):
    groups = "".join(f" (Figure {i})" for i in range(n))
    want = "see (a" + "".join(f", Figure {i}" for i in range(n)) + ") and (b) c"
    assert value(spark, T.merge_parentheticals(F.lit(f"see (a){groups} and (b) c"))) == want
    assert value(spark, T.merge_parentheticals(F.lit("Figure 1) (Table 2) x"))) == "Figure 1) (Table 2) x"


@pytest.mark.parametrize("cell", ["a|b", "`x|y` z|w", "$p|q$ r", "plain", "", "a \\\\ b", "|", "5$ | 6$ |", "`a` | $b$"])
def test_cells_with_pipes_come_back(spark, cell):
    written = value(spark, T.escape_pipes(F.lit(cell)))
    assert markdown.split_row(f"| {written} | end |") == [cell.strip(), "end"]


def brute_paragraphs(text):
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out, run = [], []
    full = [bool(x.strip(" \t\n\x0b\f\r")) for x in lines]
    for i, x in enumerate([*lines, ""]):
        if i < len(lines) and full[i]:
            run.append(i)
        elif run:
            raw = "\n".join(lines[k] for k in run) + ("\n" if run[-1] + 1 < len(lines) else "")
            out.append((run[0] + 1, run[-1] + 1, raw))
            run = []
    return out


def test_paragraphs_like_brute_force(spark):
    import hashlib

    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "bb", "\n", "\n\n", " ", "\t\n", "\r\n", "\r", "3\x01", "\x01", "é"]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += ["\n".join(f"line {i}" for i in range(20_000)), "\n" * 20_000 + "x", "x\n\n" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in N.source_map(rows).collect():
        if r.paragraph is not None:
            got.setdefault(r.doc_id, []).append((r.start_line, r.end_line, r.sha256))
    for i, t in enumerate(texts):
        want = [(a, b, hashlib.sha256(raw.encode()).hexdigest()) for a, b, raw in brute_paragraphs(t)]
        assert sorted(got.get(i, [])) == want, repr(t[:60])


def test_squeeze(spark):
    for t in ("a b", " a  b\t\u00a0c ", "\n\n", "x\u2003y z", ""):
        assert value(spark, T.squeeze(F.lit(t))) == " ".join(t.split())


def test_medians(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([None, rng.randint(0, 9) / 2, float(rng.randint(0, 99))])) for _ in range(500)] + [("d", None), (None, 1.0), (None, 4.0)]
    got = {r.k: (r.v, r.runs) for r in A.median_rows(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"]).collect()}
    for k in {r[0] for r in rows}:
        held = [v for g, v in rows if g == k]
        known = [v for v in held if v is not None]
        assert got[k] == (statistics.median(known) if known else None, len(held))


def test_many_kinds_of_a_writer(spark):
    blocks = spark.createDataFrame([(1, i, f"k{i}") for i in range(100)], "doc_id long, ordinal int, kind string")
    held = spark.createDataFrame([(f"k{i}",) for i in range(99)], "kind string")
    assert [r.kind for r in B.export_losses(blocks, held).collect()] == ["k99"]


# -- alignments ----------------------------------------------------------------------
def side(rows, codes):
    return L.Side([dict(zip(("kind", "style", "text", "label", "drawing"), (*r, None, None)[:5])) for r in rows], codes)


def plain_alignment(scores, n, m):
    """The whole table, cell by cell."""
    gap = round(L.GAP * L.UNIT)
    best = [[gap * (i + j) for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j - 1] + int(scores(i - 1)[j - 1]), best[i - 1][j] + gap, best[i][j - 1] + gap)
    out, i, j = [], n, m
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + int(scores(i - 1)[j - 1]):
            i, j = i - 1, j - 1
            out.append(("match", i, j))
        elif i and best[i][j] == best[i - 1][j] + gap:
            i -= 1
            out.append(("delete", i, None))
        else:
            j -= 1
            out.append(("insert", None, j))
    return out[::-1]


def test_alignment_like_the_whole_table():
    rng = random.Random(3)
    words = "one two three four five six seven eight nine ten".split()
    for _ in range(60):
        def rows():
            return [(rng.choice(["p"] * 6 + ["tbl", "img"]), rng.choice(["s", "Heading1", "Reference"]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 12, 30]))), rng.choice([None] * 6 + ["ref_a", "ref_b"]), rng.choice([None] * 8 + ["d1", "d2"])) for _ in range(rng.randint(0, 12))]
        one, two = rows(), rows()
        two = [r if rng.random() < 0.5 else rng.choice(one or [r]) for r in two]
        codes = {}
        a, b = side(one, codes), side(two, codes)
        scores = L.pair_scores(a, b)
        assert L.optimal(scores, len(a), len(b)) == plain_alignment(scores, len(a), len(b))


@pytest.mark.parametrize(
    "left, right, want",
    [
        (("p", "s", "same text"), ("tbl", "s", "same text"), -10), (("p", "s", "x", None, "d1"), ("p", "s", "x"), -8), (("p", "s", "Figure 1 a"), ("p", "s", "Figure 2 a"), -8), (("p", "s", "old words", "ref_k"), ("p", "s", "new", "ref_k"), 7),
        (("p", "s", "same", "ref_k"), ("p", "s", "same", "ref_j"), -8), (("p", "s", "[1] Some title"), ("p", "s", "[9] Some title"), 4.5), (("p", "s", "1. Some title"), ("p", "t", "2. Another one"), -8), (("tbl", "s", "a"), ("tbl", "s", "b"), 2),
        (("img", "s", "a"), ("img", "s", "b"), -2), (("img", "s", "a"), ("img", "s", "a"), 5), (("p", "s", ""), ("p", "s", " "), 0.5), (("p", "s", "", None, "d"), ("p", "s", "", None, "d"), 4), (("p", "s", ""), ("p", "s", "a"), -2),
        (("p", "s", "same"), ("p", "t", "same"), 6), (("p", "s", "abcd"), ("p", "s", "abcx"), 5 * 0.75 - 1), (("p", "s", "abcd"), ("p", "t", "abcx"), 5 * 0.75 - 1.5), (("p", "s", "abcd"), ("p", "s", "wxyz"), -8), (("p", "s", "a" * 60 + "b" * 60), ("p", "s", "a" * 60 + "c" * 60), -8),
    ],
)
def test_pair_scores(left, right, want):
    codes = {}
    assert L.pair_scores(side([left], codes), side([right], codes))(0)[0] == round(want * L.UNIT)


def test_long_versions_are_aligned_as_a_whole(spark):
    rows = [(1, i, "p", "s", f"paragraph {i}") for i in range(1700)]
    new = [(1, i, "p", "s", t) for i, t in enumerate(r[4] for r in rows if r[1] % 100)]
    schema = "doc_id long, ordinal long, kind string, style string, text string"
    got = L.align_versions(spark.createDataFrame(rows, schema), spark.createDataFrame(new, schema)).collect()
    assert sorted(r.base_ordinal for r in got if r.action == "delete") == [i for i in range(1700) if i % 100 == 0] and len(got) == 1700


def brute_matches(left, right):
    near = [dict(zip(j.tolist(), r.tolist())) for j, r in D.near_keys(left, right)]

    @lru_cache(maxsize=None)
    def best(i, j, skipped):
        if i == len(left) or j == len(right):
            return (0, 0, 0), ()
        options = []
        same = left[i] and left[i] == right[j]
        if same or not skipped and j in near[i]:
            (n, e, r), path = best(i + 1, j + 1, False)
            options.append(((n + 1, e + bool(same), r + (1000 if same else round(1000 * near[i][j]))), ((i, j), *path)))
        options += [best(i + 1, j, skipped), best(i, j + 1, True)]
        return max(options, key=lambda o: o[0])

    return dict(best(0, 0, False)[1])


def test_matches_like_brute_force():
    rng = random.Random(4)
    keys = ["foo", "fooo", "fo", "bar", "a repeated sentence.", "a repeated sentence!", "a repeated sentences.", "the other one here", ""]
    for _ in range(400):
        left, right = ([rng.choice(keys) for _ in range(rng.randint(0, 7))] for _ in range(2))
        assert D.match_keys(left, right) == brute_matches(left, right), (left, right)


@pytest.mark.parametrize(
    "left, right, want",
    [
        (["A repeated sentence with one edit.", "A repeated sentence."], ["A repeated sentence with one edit!", "A repeated sentence."], {0: 0, 1: 1}), (["fooo", "foo"], ["foo", "foo"], {0: 0, 1: 1}),
        (["Repeated paragraph!", "Repeated paragraph.", "The unique trailing anchor."], ["Repeated paragraph.", "Repeated paragraph.", "The unique trailing anchor."], {0: 0, 1: 1, 2: 2}), (["Repeated.", "Repeated."], ["Repeated.", "Repeated."], {0: 0, 1: 1}),
        (["abcdefgh x"], ["zzz", "abcdefgh x"], {0: 1}), ([], ["a"], {}), (["", ""], ["", ""], {}),
    ],
)
def test_matches(left, right, want):
    assert D.match_keys(left, right) == want
