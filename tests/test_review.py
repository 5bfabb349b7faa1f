"""Releases, TeX prose and reviews: what tables alone do not show."""

import pytest
from pyspark.sql import functions as F

from leafline import api
from leafline.functions import tex
from leafline.functions import text as T
from leafline.operators import review as R
from leafline.plans import pipeline as P
from leafline.plans import release


def test_releases(spark, tmp_path):
    root = f"{tmp_path}/out"
    docs = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string")
    assert release.current(spark, root) is None
    one = release.publish(spark, root, {"docs": docs("a", "b"), "more": docs("c")}, command="first")
    assert (one["version"], one["previous"], one["tables"]["docs"]["rows"]) == (1, None, 2)
    assert release.publish(spark, root, {"docs": docs("b", "a").select((1 - F.col("doc_id")).alias("doc_id"), "text"), "more": docs("c")})["version"] == 1  # equal content
    two = release.publish(spark, root, {"docs": docs("x")})
    assert (two["version"], two["previous"]) == (2, 1) and release.entry(spark, root, "docs").count() == 1
    with pytest.raises(KeyError):
        release.entry(spark, root, "more")
    back = release.take_back(spark, root)
    assert back["version"] == 3 and release.entry(spark, root, "more").count() == 1 and release.commits(spark, root).count() == 3
    assert release.publish(spark, root, {"docs": docs("x")}, force=True)["version"] == 4
    with pytest.raises(ValueError):
        release.distinct_paths(["a", "A"], root, [])
    with pytest.raises(ValueError):
        release.publish(spark, root, {"docs": docs("x")}, sources=[root])


def test_a_failed_run_publishes_nothing(spark, tmp_path):
    r = P.Registry()
    release.register(r)
    docs = {"docs": spark.createDataFrame([(1, "a")], "doc_id long, text string")}
    spec = P.Spec((P.Stage("a", "copy", consumes=("docs",), produces=("out",), parameters={"as": "out"}),))
    good = P.Runner(r).run(spark, spec, docs)
    assert release.publish_result(spark, f"{tmp_path}/r", good, ["out"])["tables"]["out"]["rows"] == 1
    bad = P.Runner(r).run(spark, P.Spec(spec.stages, required_artifacts=("none",)), docs)
    with pytest.raises(ValueError):
        release.publish_result(spark, f"{tmp_path}/r", bad, ["out"])


def test_write_keeps_losses_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "\\section{A}\\begin{weird}y\\end{weird}")], "doc_id long, text string")
    held = api.write(spark, docs, "latex", "markdown", f"{tmp_path}/w")
    assert held["tables"]["texts"]["rows"] == 1 and held["tables"]["losses"]["rows"] == 1
    with pytest.raises(ValueError):
        api.write(spark, docs, "latex", "markdown", f"{tmp_path}/w", fidelity="preserve")


@pytest.mark.parametrize(
    "text, plain",
    [
        (r"Hello \alpha and $x_i$.", "Hello α and xi."), (r"$r = 5.6$ and $\delta \approx 0.909$", "r = 5.6 and δ ≈ 0.909"), (r"$r_c = \highlight{5.6}$ and $\approx \highlight{0.909}$", "rc = 5.6 and ≈ 0.909"), (r"X $>$ A $\approx$ B", "X > A ≈ B"),
        (r"\texorpdfstring{ABX$_4$}{ABX4} branch", "ABX4 branch"), (r"\href{https://e.test}{\textbf{Link}}", "Link"), (r"set \texttt{n\_dim} here", "set n_dim here"), (r"\begin{center}\vspace{12pt}\begin{minipage}{0.98\textwidth}\textsuperscript{\#}Equal\end{minipage}\end{center}", "#Equal"),
        (r"Both `1/80' and ``SY''.", "Both ‘1/80’ and “SY”."), (r"the model's $b'$ term", "the model’s b' term"), (r"a--b---c~d 5\% % gone", "a–b—c\u00a0d 5% "), (r"$\frac{a}{b-1}$", "a/b–1"), ("", ""), ("{", ""), ("$x", "x"), (r"a\\[2em]b", "a b"), ("\\", ""), (r"\textbf{", ""),
    ],
)
def test_tex_prose(text, plain):
    assert tex.plain(text) == plain


def test_tex_styles():
    digits = [s for t, s in tex.tokenize(r"$r = 5.6$") if "5.6" in t]
    assert len(digits) == 1 and not digits[0].italic
    assert all(not s.italic for t, s in tex.tokenize(r"$r_c = \highlight{5.6}$") if s.highlight) and any(s.sub for t, s in tex.tokenize("$x_i$"))
    assert [t for t, s in tex.tokenize(r"set \texttt{n\_dim} here") if s.mono] == ["n_dim"] and tex.tokenize(r"\textbf{bold}")[0][1].bold
    found = tex.plain(r"\autoref{overview} and \cref{fig:a,tab:ed_x}, \ref{q}", {"overview": "1", "fig:a": "2", "tab:ed_x": "3"}.get, {"overview": "figure"}.get)
    assert found == "Figure 1 and Figure 2, Extended Data Table 3, q"


def test_table_edits_replay(spark):
    rows = lambda *r: spark.createDataFrame([(1, 1, i, list(c)) for i, c in enumerate(r)], "doc_id long, table_id long, row long, cells array<string>")
    base, now = rows(("a", "b"), ("c", "d"), ("e", "f"), ("x",)), rows(("a", "b"), ("c", "d two"), ("new", "row"), ("x", "y"))
    found = R.table_redline(base, now).orderBy("step").collect()
    text = lambda r, gone: tuple("".join(e.text for e in cell if e.op != gone) for cell in r.cells)
    assert [text(r, "delete") for r in sorted((r for r in found if r.current_row is not None), key=lambda r: r.current_row)] == [("a", "b"), ("c", "d two"), ("new", "row"), ("x", "y")]
    assert [text(r, "insert") for r in sorted((r for r in found if r.base_row is not None), key=lambda r: r.base_row)] == [("a", "b"), ("c", "d"), ("e", "f"), ("x",)]
    assert {r.action for r in R.table_redline(base, base.limit(0)).collect()} == {"delete"}


def test_overlapping_review_spans(spark):
    pairs = lambda *t: spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "doc_id long, ordinal int, text string")
    got = R.review_bundle(pairs("one two", "two three", "alone", "same"), pairs("1", "2", "3", "same"), spark.createDataFrame([(1, "one two three and alone")], "doc_id long, text string"))
    assert {r.ordinal: r.status for r in got.collect()} == {0: "overlap", 1: "overlap", 2: "ready"}


def test_names_and_math(spark):
    names = spark.createDataFrame([(1, 0, "a.png"), (1, 1, "A.png"), (1, 2, "b")], "doc_id int, ordinal int, name string")
    assert [r.target for r in T.distinct_names(names, ["doc_id"], "name", "ordinal").orderBy("ordinal").collect()] == ["a.png", "A-2.png", "b"]
    shown = spark.range(1).select(T.backend_math(F.lit(r"\dfrac{a}{b} \bm{x}\label{eq:1} \operatorname*{argmin} \nonumber")).alias("v")).first().v
    assert shown == r"\frac{a}{b} \mathbf{x} \operatorname{argmin}"


def test_template_closure_beyond_a_million(spark, tmp_path):
    """Parts whose keys reach the range of the links, and keys with gaps, give the rows of the SQL."""
    import duckdb

    from leafline import catalog

    keys = [*range(0, 200), *range(999_900, 1_000_400), *range(1_500_000, 1_500_100)]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["template_closure"]).fetchall()
    assert sorted(map(tuple, catalog.queries()["template_closure"](spark, str(tmp_path)).collect())) == sorted(want)


def test_template_closure_by_the_styles_given(spark):
    styles = spark.createDataFrame([("a", "b", None), ("b", "gone", "a")], "style string, based_on string, link string")
    wanted = spark.createDataFrame([("a",)], "style string")
    assert {tuple(r) for r in R.template_closure(styles, wanted).collect()} == {("a", False), ("b", False), ("gone", True)}
    assert {tuple(r) for r in R.template_closure(styles, wanted, has=F.col("style") != "b").collect()} == {("a", False), ("b", True), ("gone", False)}


def package(paragraphs):
    import io
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:pPr><w:pStyle w:val='{s}'/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='{w}'><w:body>{body}{table}</w:body></w:document>")
    return buf.getvalue()


def test_commands_over_packages(spark, tmp_path):
    from leafline.__main__ import main

    for name, text in (("one", "old words here"), ("two", "old words there")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "d.docx").write_bytes(package([("Heading1", "Head"), ("Normal", text)]))
    at = lambda n: str(tmp_path / n)
    assert main(["export", at("one"), at("md")]) == 0
    assert spark.read.parquet(at("md")).first().text == "# Head\n\nold words here\n\n| a\\|b | c |\n| --- | --- |"
    assert main(["export-block-map", at("one"), at("map")]) == 0 and [r.opaque for r in spark.read.parquet(at("map")).orderBy("ordinal").collect()] == [False, False, True]
    assert main(["redline", at("one"), at("two"), at("red")]) == 0
    rows = spark.read.parquet(at("red")).orderBy("step").collect()
    assert [r.action for r in rows] == ["match"] * 3 and [(e.op, e.text) for e in rows[1].edits] == [("equal", "old words "), ("delete", "here"), ("insert", "there")]
    assert main(["check", at("one")]) == 0
    (tmp_path / "one" / "broken.docx").write_bytes(b"no package")
    assert main(["check", at("one")]) == 1
    assert main(["publish", at("two"), at("root"), "--source", "docx", "--target", "markdown"]) == 0
    assert release.entry(spark, at("root"), "texts").count() == 1
    for name, text in (("a", "x one\n\ny two"), ("b", "x one\n\ny three")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.md").write_text(text, encoding="utf-8")
    assert main(["plan-delta", at("a"), at("b"), at("plan")]) == 0
    assert [(r.op, r.text) for r in spark.read.parquet(at("plan")).collect()] == [("replace", "y three")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "s.json").write_text('[{"title":"T","bullets":["b"]},{"title":""}]', encoding="utf-8")
    assert main(["slides", at("s")]) == 1
