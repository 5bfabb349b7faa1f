"""Rules that tables alone do not show: ambiguous lines, errors, replays, pipelines, streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from leafline.functions import biblio, inline, ranges
from leafline.functions import text as T
from leafline.operators import align, blocks, citations, gates
from leafline.operators import aggregates as A
from leafline.plans import pipeline as P
from leafline.sources import bibtex, docx, latex, markdown


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("labels, want", [(["1", "2", "4", "5", "6"], "[1,2,4–6]"), (["S2", "S1", "S3", "7"], "[7,S1–S3]"), (["x", "2", "2"], "[2,x]"), ([], "")])
def test_bracketed(spark, labels, want):
    assert value(spark, ranges.bracketed(F.array(*map(F.lit, labels)).cast("array<string>"))) == want


@pytest.mark.parametrize("text, want", [("1–3,7", [1, 2, 3, 7]), ("3-1", None), ("a", None), ("5", [5])])
def test_numbers_of(spark, text, want):
    assert value(spark, ranges.numbers_of(F.lit(text))) == want


def test_given_order_stays(spark):
    assert value(spark, ranges.in_order(F.array(*map(F.lit, [7, 1, 2, 3])))) == "7,1–3"


@pytest.mark.parametrize("line, want", [("a \\% b % c", "a \\% b "), ("x", "x"), ("% all", ""), ("a\\\\% b", "a\\\\")])
def test_strip_comment(spark, line, want):
    assert value(spark, T.strip_comment(F.lit(line))) == want


@pytest.mark.parametrize("text, want", [("a\r\nb\x0bc d\n", ["a", "b", "c", "d"]), ("", []), ("a\n\n", ["a", ""])])
def test_split_lines(spark, text, want):
    assert value(spark, T.split_lines(F.lit(text))) == want == text.splitlines()


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("[1] x", ["reference"]), ("| a |\n|---|\n| b |", ["table"]), ("a\nb\n\nc", ["paragraph", "paragraph"]), ("---", ["separator"]), ("  - x", ["bullet"]), ("```math\nx\n```", ["equation"]), ("\\Table note: x", ["paragraph"]),
        ("| a | b |\n|---|---|\n| 1 |", ["error"]), ("$$\nx", ["error"]), ("a $$ b", ["error"]), ("Table span: page\n\ntext", ["error"]), ("Table: Table 5. x", ["error"]), ("Table 2. prose", ["paragraph"]), ("Table 2. C\n\n| a |\n|---|", ["table_caption", "table"]),
        ("", []), (None, []),
    ],
)
def test_markdown_dispatch(text, kinds):
    assert [b["kind"] for b in markdown.parse(text)] == kinds


@pytest.mark.parametrize("row, cells", [("| a | `b|c` | $x|y$ | d\\|e |", ["a", "`b|c`", "$x|y$", "d|e"]), ("||", [""]), ("| a || b |", ["a", "", "b"])])
def test_split_row(row, cells):
    assert markdown.split_row(row) == cells


def test_explicit_notes():
    assert [b["kind"] for b in markdown.parse("| a |\n|---|\n[a] x\n\nTable note: y", notes="explicit")] == ["table", "paragraph", "paragraph"]
    assert [b["kind"] for b in markdown.parse("| a |\n|---|\n[a] x", notes="legacy")] == ["table", "table_foot"]


def test_bibtex_last_definition_first_place(spark):
    docs = spark.createDataFrame([(1, "@a{k, t={1}} @b{j, t=\"x\" # {y}} @c{k, t={2 {n} # m}}")], "doc_id long, text string")
    assert [(r.ordinal, r.key, r.fields) for r in bibtex.entries(bibtex.bibtex(docs)).orderBy("ordinal").collect()] == [(0, "k", {"t": "2 {n} # m"}), (1, "j", {"t": "xy"})]
    bad = spark.createDataFrame([(1, "@a{k, t={1"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.error for r in bibtex.bibtex(bad).collect()] == ["bibtex.unclosed_value"]


def test_json_entries(spark):
    docs = spark.createDataFrame([(1, json.dumps({"a": {"Title": "T", "_type": "book"}, "_x": {}, "r": " raw "}))], "doc_id long, text string")
    assert {r.key: (r.entry_type, r.fields) for r in bibtex.json_entries(docs).collect()} == {"a": ("book", {"title": "T"}), "r": ("misc", {"raw": "raw"})}


def test_replace_citations(spark):
    docs = spark.createDataFrame([(1, "x \\cite{a} \\citep{b,c} y \\cite{zz}.")], "doc_id long, text string")
    numbers = spark.createDataFrame([(1, "a", "4"), (1, "b", "5"), (1, "c", "6")], "doc_id long, key string, label string")
    r = citations.replace(docs, numbers, ranges.sorted_pairs).first()
    assert r.text == "x [4–6] y \\cite{zz}." and r.missing == ["zz"]


def test_inline_round_trip():
    for text in ["a **b *c* d** `e`", "x<sub>2</sub> $m$ [l](u) \\cite{k,j}", "plain", ""]:
        tree = inline.nodes(text)
        assert inline.nodes(inline.write_markdown(tree)) == tree
        assert [n["kind"] for n in inline.latex_nodes(inline.write_latex(tree))] == [n["kind"] for n in tree if True][: len(tree)] or "code" in {n["kind"] for n in tree}
    assert inline.key(" 3. **A**–b ") == "A-b"


def test_latex_expand_inputs(spark):
    files = spark.createDataFrame([(1, "m.tex", "\\input{a} % \\input{no}"), (1, "a.tex", "\\include{b.tex}"), (1, "b.tex", "\\input{a}")], "doc_id long, name string, text string")
    assert {(r.file, r.depth) for r in latex.expand_inputs(files).collect()} == {("m.tex", 0), ("a.tex", 1), ("b.tex", 2)}


def test_alignment_replays(spark):
    rows = [(1, i, "p", "s", t) for i, t in enumerate(["same one", "gone entirely", "a long sentence that will change a bit only here", "tail"])]
    new = [(1, i, "p", "s", t) for i, t in enumerate(["same one", "a long sentence that will change a lot only here", "fresh words", "tail"])]
    schema = "doc_id long, ordinal long, kind string, style string, text string"
    edits = align.align_versions(spark.createDataFrame(rows, schema), spark.createDataFrame(new, schema)).orderBy("step").collect()
    assert [e.current_ordinal for e in edits if e.action != "delete"] == [0, 1, 2, 3]
    assert [e.base_ordinal for e in edits if e.action != "insert"] == [0, 1, 2, 3]
    one_side = align.align_versions(spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)).collect()
    assert {e.action for e in one_side} == {"delete"}


@pytest.mark.parametrize("a, b", [("a b c", "a x c"), ("", "new"), ("old", ""), ("same", "same")])
def test_word_edits(a, b):
    e = align.word_edits(a, b)
    assert "".join(t for o, t in e if o != "insert") == a and "".join(t for o, t in e if o != "delete") == b


def test_docx(spark):
    buf = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r r:id='rId9'><w:t>A</w:t></w:r><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p></w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", "<R xmlns='x'><Relationship Id='rId1' Target='media/gone.png'/></R>")
    files = spark.createDataFrame([("a.docx", bytearray(buf.getvalue())), ("b.docx", bytearray(b"no"))], "path string, content binary")
    rows = {r.path: r for r in docx.blocks(files).collect()}
    assert (rows["a.docx"].text, rows["a.docx"].original, rows["a.docx"].style, rows["a.docx"].revised) == ("Anew", "Aold", "Heading1", True)
    assert rows["b.docx"].error == "docx.BadZipFile"
    assert {r.code for r in docx.audit(files).collect()} == {"package.target_missing", "package.dangling_id"}


def test_validate(spark):
    nodes = spark.createDataFrame([(1, "n1", "figure", "r9", None, 0, 1), (1, "n1", "p", None, None, 3, 1), (1, "n2", "reference", None, " ", 0, 1)], "doc_id long, node_id string, kind string, target string, key string, start int, stop int")
    res = spark.createDataFrame([(1, "r1"), (1, "r1")], "doc_id long, resource_id string")
    assert sorted(r.code for r in blocks.validate(nodes, res).collect()) == ["figure.resource_missing", "node.bad_span", "node.duplicate_id", "reference.empty_key", "resource.duplicate_id"]


def test_properties(spark):
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    got = value(spark, A.merge_properties(m({"a": "1", "b": "2", "b@x": "3"}), m({"-b": "", "a": "9"})))
    assert got == {"a": "9"}
    assert value(spark, A.parse_properties(F.lit('a=1 b="x y" c'))) == {"a": "1", "b": "x y", "c": ""}
    assert value(spark, A.clean_properties(m({"rsidR": "1", "b": "2"}))) == {"b": "2"}


def test_publication_policy(spark):
    f = spark.createDataFrame([(1, "warning", "loss"), (2, "info", "style")], "doc_id long, level string, category string")
    assert {r.doc_id: r.allowed for r in gates.allows_publication(f).collect()} == {1: False, 2: True}
    assert [r.level for r in gates.escalate(f, True).orderBy("doc_id").collect()] == ["error", "info"]


def registry():
    r = P.Registry()
    r.add("stage", "lines", lambda inputs, p: {"out": inputs["docs"].withColumn("n", F.length("text"))})
    r.add("stage", "boom", lambda inputs, p: 1 / 0)
    r.add("gate", "long", lambda arts, p: arts["out"].where(F.col("n") > p["most"]).select(F.lit("warning").alias("severity"), F.lit("gate.long").alias("code"), F.col("doc_id").cast("string").alias("subject")))
    return r


def test_pipeline(spark, tmp_path):
    docs = {"docs": spark.createDataFrame([(1, "abc"), (2, "abcdef")], "doc_id long, text string")}
    spec = P.Spec((P.Stage("a", "lines", consumes=("docs",), produces=("out",)), P.Stage("b", "boom", depends_on=("a",)), P.Stage("c", "lines", depends_on=("b",), consumes=("docs",))), gates=({"id": "g", "kind": "long", "parameters": {"most": 4}},), required_artifacts=("out",))
    got = P.Runner(registry(), str(tmp_path)).run(spark, spec, docs)
    assert got.status == "fail" and [s["state"] for s in got.manifest["stages"]] == ["done", "failed", "blocked"]
    assert {d["code"] for d in got.diagnostics} == {"stage.failed", "stage.blocked", "gate.long"}
    assert P.Runner(registry()).run(spark, P.Spec(spec.stages[:1], spec.gates), docs).status == "warn"
    assert "/" not in P.canonical("see /tmp/x/y now").replace("<absolute-path>", "")


def test_preflight():
    r = registry()
    s = P.Stage
    assert ("stage.unknown_kind", "x") in P.preflight(P.Spec((s("x", "none"),)), r, set())
    assert P.preflight(P.Spec((s("x", "lines", ("y",)), s("y", "lines", ("x",)))), r, set())[0][0] == "pipeline.cycle"
    assert ("stage.input_not_upstream", "y:out") in P.preflight(P.Spec((s("x", "lines", produces=("out",)), s("y", "lines", consumes=("out",)))), r, set())
    with pytest.raises(ValueError):
        r.add("stage", "lines", print)


def test_style_stream(spark, tmp_path):
    from leafline.streaming.gates import style_stream

    src, rows = str(tmp_path / "in"), [(1, "a — b", "2024-01-01 00:00:00"), (1, "a — b", "2024-01-01 00:00:01"), (2, "ok", "2024-01-01 00:00:02")]
    spark.createDataFrame(rows, "doc_id long, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    q = style_stream(spark.readStream.schema("doc_id long, text string, ts timestamp").parquet(src)).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == 1


def test_biblio_raw_and_errors(spark):
    f = F.create_map(F.lit("raw"), F.lit("As it is"))
    assert value(spark, biblio.plain(f)) == value(spark, biblio.markdown(f)) == "As it is"
    with pytest.raises(ValueError):
        biblio.format_entry(f, "none")


def test_source_pack(spark):
    files = spark.createDataFrame([("a/x.tex", "1"), ("a/x.tex", "1"), ("b/y.png", "22"), ("c.md", "")], "path string, content string")
    got = [(r.Path, r.Size_bytes) for r in A.source_pack(files, ["a/*.tex", "?.md"]).collect()]
    assert got == [("a/x.tex", 1), ("c.md", 0)]


def test_small_formats(spark, tmp_path):
    from leafline.sources import files as S

    docs = spark.createDataFrame([(1, "---\nname: A b\nbad: x\n---\nBody\n"), (2, "no head")], "doc_id long, text string")
    got = {r.doc_id: (r.meta, r.body, r.unknown) for r in S.prompts(docs, ["name"]).collect()}
    assert got == {1: ({"name": "A b"}, "Body", ["bad"]), 2: ({}, "no head", [])}
    assert S.profile("a: 1\nb:\n  c: true # x\n  d: {e: 'f', g: 2.5}\n") == {"a": 1, "b": {"c": True, "d": {"e": "f", "g": 2.5}}}
    paths, names = spark.createDataFrame([("p/one.md",), ("p/two.md",)], "path string"), spark.createDataFrame([("one",), ("two.md",), ("gone",)], "name string")
    held, gone = S.select_prompts(paths, names)
    assert [r.path for r in held.collect()] == ["p/one.md", "p/two.md"] and [r.name for r in gone.collect()] == ["gone"]
    (tmp_path / "d.md").write_text("# T\n\nx", encoding="utf-8")
    assert [(r.format, r.text) for r in S.documents(spark, str(tmp_path)).collect()] == [("markdown", "# T\n\nx")]


def test_command_line(spark, tmp_path):
    from leafline.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.md").write_text("# T\n\nuse the QQX here", encoding="utf-8")
    assert main(["gate", "abbr", str(tmp_path / "in")]) == 1
    assert main(["gate", "style", str(tmp_path / "in")]) == 0
    assert main(["convert", str(tmp_path / "in"), str(tmp_path / "out"), "--target", "latex"]) == 0
    assert "\\section{T}" in spark.read.parquet(str(tmp_path / "out")).first()["text"]
    assert main(["pipeline", str(tmp_path / "none.json"), str(tmp_path / "in")]) == 2
