"""All queries of the library with their SQL twins, by name.

Texts that the tables lack (Markdown, TeX, BibTeX) are rendered from relational rows; the SQL twin
works the expected rows out from those rows, never from the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import biblio, inline, ranges
from .functions import text as T
from .operators import aggregates as A
from .operators import align as L
from .operators import blocks as B
from .operators import citations as C
from .operators import delta as D
from .operators import gates as G
from .operators import lines as N
from . import api
from .sources import bibtex, files, html, latex, markdown

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- lines and gates -----------------------------------------------------------------
LINES_SQL = r"""l AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) AS line_no FROM
 (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E]') AS a FROM documents))"""
PROSE_SQL = r"""trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '(^|[^\\])%.*$', '\1'),
 '\\(?:cite\w*|ref|eqref|label|url|path|includegraphics|input|bibliography)\*?(?:\[[^\]]*\])?\{[^{}]*\}', ' ', 'g'), '\$[^$]*\$|\\\([^)]*\\\)|\\\[[^\]]*\\\]', ' ', 'g'),
 '\\[A-Za-z@]+\*?(?:\[[^\]]*\])?', ' ', 'g'), '\%', '%'), '\s+', ' ', 'g'))"""


@query(rf"""WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, {PROSE_SQL} AS line FROM l),
 s AS (SELECT doc_id, line_no, line, unnest(regexp_extract_all(regexp_replace(line, '[À-ÖØ-öø-ɏͰ-῿぀-힯]', 'x', 'g'), '\b[A-Z][A-Z0-9-]+\b')) AS acronym FROM p),
 g AS (SELECT doc_id, acronym, bool_or(regexp_matches(line, '[A-Za-z][A-Za-z0-9 -]{{2,}}\(\s*' || acronym || '\s*\)')) AS defined, min(line_no) AS line_no
  FROM s WHERE acronym NOT IN ('AI','API','DOI','GPU','ORCID','PDF','SI','URL') GROUP BY ALL)
 SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, acronym, 'ABBR_UNDEFINED' AS rule, 'Define abbreviation ' || acronym || ' at first use.' AS message FROM g WHERE NOT defined""")
def gate_abbreviations(spark, sf):
    """Acronyms without a definition."""
    return G.abbreviations(table(spark, sf, "documents"))


@query(r"""WITH c AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS k FROM orders)
 SELECT doc_id, CAST(CASE k WHEN 0 THEN 2 ELSE 1 END AS INTEGER) AS line_no, 'QX' || k AS acronym, CASE k WHEN 1 THEN 'ABBR_UNUSED' ELSE 'ABBR_UNDEFINED' END AS rule,
  CASE k WHEN 1 THEN 'Remove abbreviation QX1; it is defined but not reused.' ELSE 'Define abbreviation QX' || k || ' at first use.' END AS message FROM c""")
def gate_abbreviation_reuse(spark, sf):
    """Both rules of the gate on rendered lines, with a configured whitelist joined."""
    k = F.col("o_orderkey") % 3
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(k == 0, "The API of\n% QX9 hidden\\cite{QX8}\nno QX0 here").when(k == 1, "quick exam ( QX1 ) once, ZZTOP").otherwise("QX2 and $QX7$ then QX2 and GPU").alias("text"))
    docs = docs.withColumn("text", F.regexp_replace("text", "\n% QX9 hidden", ""))
    return G.abbreviations(docs, G.whitelist(spark, [" ZZTOP "]), require_reuse=True)


STYLE_EXTRA = [("LOUD", r"[A-Z]{3,}!!", "Lower the voice."), ("SYMBOL_RUN", r"[#$%&*]{3,}", "Spell signs out.")]
STYLE_SQL = rf"""WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, {PROSE_SQL} AS excerpt FROM l),
 r(rule, message, pattern) AS (VALUES ('LOUD', 'Lower the voice.', '[A-Z]{{3,}}!!'), ('SYMBOL_RUN', 'Spell signs out.', '[#$%&*]{{3,}}')),
 f AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, rule, message, excerpt, unnest(regexp_extract_all(excerpt, pattern)) AS token FROM p, r WHERE excerpt <> ''),
 g AS (SELECT *, rule || ':' || substr(sha256(doc_id || '|' || rule || '|' || excerpt || '|' || token), 1, 20) AS fingerprint FROM f)"""


@query(STYLE_SQL + " SELECT doc_id, line_no, rule, message, excerpt, token, fingerprint FROM g")
def gate_style(spark, sf):
    """Every match of the prose rules, two of them configured."""
    return G.style(table(spark, sf, "documents"), STYLE_EXTRA)


@query(STYLE_SQL + " SELECT doc_id, line_no, rule, message, excerpt, token, fingerprint FROM g WHERE fingerprint NOT IN (SELECT fingerprint FROM g WHERE doc_id % 2 = 0)")
def gate_style_unresolved(spark, sf):
    """Findings beyond a baseline made of the even documents; the findings are worked out once."""
    found = G.style(table(spark, sf, "documents"), STYLE_EXTRA).persist()
    return G.unresolved(found, G.baseline(found.where("doc_id % 2 = 0"))).select("doc_id", "line_no", "rule", "message", "excerpt", "token", "fingerprint")


@query(r"""WITH r AS (SELECT o_orderkey AS doc_id, 1 AS line_no, 'EM_DASH' AS rule, 'a — b ' || o_custkey AS excerpt, '—' AS token FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT o_orderkey, 2, 'NUMERIC_HYPHEN_RANGE', 'from ' || o_custkey || ' - ' || o_orderkey || ' on', o_custkey || ' - ' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0
 UNION ALL SELECT o_orderkey, 3, 'UNICODE_SCRIPT', 'H₂O and x² of ' || o_custkey, unnest(['₂', '²']) FROM orders WHERE o_orderkey % 5 = 0)
 SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, rule, token, excerpt, rule || ':' || substr(sha256(doc_id || '|' || rule || '|' || excerpt || '|' || token), 1, 20) AS fingerprint FROM r""")
def gate_style_rules(spark, sf):
    """The built-in prose rules on rendered lines: marked words in commands, math and comments do not count."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    first = F.when(k % 2 == 0, F.concat(F.lit("a — \\emph{}b "), c, F.lit(" % no — here"))).otherwise("a - b \\ref{x—y}")
    second = F.when(k % 3 == 0, F.concat(F.lit("from "), c, F.lit(" - "), k, F.lit("   on"))).otherwise("$1 - 2$ and 3-4")
    third = F.when(k % 5 == 0, F.concat(F.lit("H₂O and x² of "), c)).otherwise("\\cite{x²} H2O")
    docs = table(spark, sf, "orders").select(k.alias("doc_id"), F.concat_ws("\n", first, F.regexp_replace(second, "\\{\\}", ""), third).alias("text"))
    docs = docs.withColumn("text", F.replace("text", F.lit("\\emph{}b"), F.lit("\\textbf b")))
    return G.style(docs).drop("message")


@query(r"""SELECT 'reference' AS kind, 'fig:m' || n_nationkey AS label, 'references an undefined label' AS message FROM nation WHERE n_nationkey % 5 = 1
 UNION ALL SELECT 'tab', 'tab:n' || n_nationkey, 'main figure/table is never cited in main prose' FROM nation WHERE n_nationkey % 4 = 0
 UNION ALL SELECT 'duplicate', 'fig:d', 'duplicate label'""")
def gate_references(spark, sf):
    """Undefined, uncited and duplicate float labels of TeX sources."""
    k = F.col("n_nationkey")
    text = F.concat(F.lit("\\label{tab:n"), k, F.lit("} % \\ref{fig:hidden}\n"), F.when(k % 4 != 0, F.concat(F.lit("see \\ref{tab:n"), k, F.lit("}"))).otherwise("50\\% \\ref{sec:x}"), F.when(k % 5 == 1, F.concat(F.lit(" and \\ref*{fig:m"), k, F.lit("}"))).otherwise(""), F.when(k < 2, "\\label{fig:d} \\ref{fig:d}").otherwise(""))
    return G.references(table(spark, sf, "nation").select(k.alias("doc_id"), text.alias("text")))


@query(r"""SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN [] WHEN 1 THEN [5] WHEN 2 THEN [0, 3] ELSE [2] END::INTEGER[] AS bad FROM orders""")
def quote_pairs(spark, sf):
    """Offsets of quotation marks without a partner."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "“a ‘b’ c”").when(k == 1, "“a” b”").when(k == 2, "“a ‘ b").otherwise("a ’b")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), G.quote_errors(text).alias("bad"))


PARA_SQL = r"""t AS (SELECT doc_id, regexp_replace(text, '[.] ', E'.\n\n', 'g') AS text FROM documents),
 l AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) AS n, len(a) AS m FROM (SELECT doc_id, string_split(text, E'\n') AS a FROM t)),
 i AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM l WHERE regexp_matches(raw, '\S')),
 p AS (SELECT doc_id, min(n) AS a, max(n) AS b, string_agg(raw, E'\n' ORDER BY n) || CASE WHEN max(n) < max(m) THEN E'\n' ELSE '' END AS raw FROM i GROUP BY doc_id, g)"""


def _paragraphs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[.] ", ".\n\n").alias("text"))


@query(rf"""WITH {PARA_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS paragraph, CAST(a AS INTEGER) AS start_line,
 CAST(b AS INTEGER) AS end_line, sha256(raw) AS sha256 FROM p""")
def source_map(spark, sf):
    """Paragraphs with their lines and hashes."""
    return N.source_map(_paragraphs(spark, sf)).drop("text")


@query(rf"""WITH {PARA_SQL} SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(trim(regexp_replace(raw, '\s+', ' ', 'g')))) AS BIGINT) AS n_chars FROM p GROUP BY doc_id""")
def text_chunks(spark, sf):
    """Blank-line chunks and what they hold."""
    c = N.chunks(_paragraphs(spark, sf))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\s+|[\p{L}\p{N}]+(?:[’''][\p{L}\p{N}]+)*|_|[^\p{L}\p{N}\s]')) AS INTEGER) AS n_tokens, sha256(text) AS sha256 FROM documents""")
def text_tokens(spark, sf):
    """Tokens of the word diff, and content hashes."""
    return table(spark, sf, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.sha2("text", 256).alias("sha256"))


@query(r"""SELECT p_partkey AS doc_id, 'A' || chr(8211) || 'B ' || chr(8211) || ' N' || chr(8211) || 'H, (x, Figure ' || p_size || ', Table 2) (PDF)' AS text, CASE WHEN p_size < 10 THEN 'H2O' ELSE 'x' || p_size END AS ascii,
 substr('Figure ' || p_size || ' shows ' || p_name, 1, 9) || chr(8230) AS cut, CASE WHEN p_size % 2 = 0 THEN 'Figure ' || p_size END AS float FROM part""")
def typography(spark, sf):
    """Dashes, bonds, adjacent parentheticals, script glyphs, float labels, cut excerpts."""
    n = F.col("p_size").cast("string")
    raw = F.concat(F.lit("A&ndash;B — N-H, (x) (Figure "), n, F.lit(") (Table 2) (PDF)"))
    said = F.concat(F.when(F.col("p_size") % 2 == 0, "Figure ").otherwise("Fig. "), n, F.lit(" shows "), F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), T.clean_markdown(F.concat(raw, F.lit("<!-- x\ny -->"))).alias("text"), T.script_ascii(F.when(F.col("p_size") < 10, "H₂O").otherwise(F.concat(F.lit("x"), n))).alias("ascii"), T.truncated(F.concat(F.lit("Figure "), n, F.lit(" shows "), F.col("p_name")), 10).alias("cut"), T.float_label(said).alias("float"))


@query(r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/' || page_id || '.png' WHEN 1 THEN NULL WHEN 2 THEN 'b.txt' ELSE NULL END AS portable, CASE page_id % 2 WHEN 0 THEN 'media/x.png' ELSE NULL END AS target,
 'see <absolute-path> now' AS redacted, CASE page_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'latex' ELSE 'unsupported' END AS format, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages""")
def paths(spark, sf):
    """Portable paths, package targets, redaction, formats and hosts."""
    i = F.col("page_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit("./a/x/../"), i, F.lit(".png"))).when(i % 4 == 1, "../up").when(i % 4 == 2, "a\\..\\b.txt").otherwise("/abs/x")
    return table(spark, sf, "pages").select("page_id", T.portable_path(raw).alias("portable"), T.package_target(F.lit("word/document.xml"), F.when(i % 2 == 0, "/media/x%2Epng#f").otherwise("http://h/x")).alias("target"), T.redact_paths(F.concat(F.lit("see /home/u"), i, F.lit("/f.md now"))).alias("redacted"), T.source_format(F.concat(F.lit("d."), F.element_at(F.array(F.lit("md"), F.lit("TeX"), F.lit("xyz")), (i % 3 + 1).cast("int")))).alias("format"), T.endpoint_host(F.col("url")).alias("host"))


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)</?(?:b|strong)>')) AS INTEGER) * 2 + CAST(len(regexp_extract_all(html, '\*')) AS INTEGER) AS stars FROM pages""")
def inline_html(spark, sf):
    """Emphasis elements as Markdown."""
    return table(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all(T.normalize_inline_html(F.col("html")), F.lit(r"\*"), F.lit(0))).alias("stars"))


@query(r"""SELECT n_nationkey AS doc_id, '| ' || r_name || ' | ' || n_name || ' |' || E'\n| --- | --- |\n| ' || r_name || ' | **' || n_nationkey || '** |' AS text FROM nation JOIN region ON n_regionkey = r_regionkey""")
def html_tables(spark, sf):
    """HTML tables with spans as pipe tables."""
    t = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = F.concat(F.lit("<table><tr><th rowspan=\"2\">"), "r_name", F.lit("</th><td>"), "n_name", F.lit("</td></tr>\n<tr><td><b>"), "n_nationkey", F.lit("</b><br></td></tr></table>"))
    return t.select(F.col("n_nationkey").alias("doc_id"), html.tables_to_pipes(raw).alias("text"))


# -- Markdown documents rendered from the tables ----------------------------------------
def _nation_docs(spark, sf) -> DataFrame:
    """One document a nation: a heading, an abstract, a captioned supplier table with notes, an image, bullets."""
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.concat(F.lit("| "), x["s_suppkey"], F.lit(" | "), x["s_name"], F.lit("\\|x<sup>[a]</sup> |"))), "\n").alias("rows"))
    n = F.col("n_nationkey")
    text = F.concat(
        F.lit("# Abstract\n\nOf "), "n_name", F.lit(".\nmore\n\nKeywords: a, b\n\n# "), "n_name", F.lit("\n\nTable"), F.when(n % 3 == 0, F.concat(F.lit(" "), n + 1, F.lit("."))).otherwise(":"), F.lit(" Suppliers.|span=page\n\n| id | name |\n|:---|---:|\n"), "rows",
        F.lit("\nTable note: [a] First.\n"), F.when(n % 4 == 1, "Table note: [a] Again.\n").otherwise(""), F.lit("\n![alt "), n, F.lit("](img/x.png)\n\n"), F.when(n % 2 == 0, F.concat(F.lit("Figure 1. Map "), n, F.lit(".\n\n"))).otherwise(""), F.lit("- one\n  - two\n\n---\n\n> said\n\n```py\nx = 1\n```\n\n$$\na+b\n$$\n\n[1] Ref.\n\nTable note: lost\n"),
    )
    return table(spark, sf, "nation").join(s, "n_nationkey").select(n.cast("long").alias("doc_id"), text.alias("text"))


NATIONS_SQL = "n AS (SELECT n_nationkey AS k, n_name, count(*) AS c FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)"


@query(rf"""WITH {NATIONS_SQL}, b AS (SELECT k, unnest(['heading','paragraph','keywords','heading','table_caption','table','table_foot'] || CASE WHEN k % 4 = 1 THEN ['table_foot'] ELSE [] END || ['image']
 || CASE WHEN k % 2 = 0 THEN ['paragraph'] ELSE [] END || ['bullet','bullet','separator','quote','code','equation','reference','table_foot']) AS kind FROM n)
 SELECT CAST(k AS BIGINT) AS doc_id, kind, count(*) AS n FROM b GROUP BY ALL""")
def md_block_kinds(spark, sf):
    """Blocks of rendered Markdown by kind."""
    return markdown.blocks(_nation_docs(spark, sf)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(s_nationkey AS BIGINT) AS doc_id, CAST(s_suppkey AS VARCHAR) AS id, s_name || '|x<sup>[a]</sup>' AS name FROM supplier")
def md_table_cells(spark, sf):
    """Cells of rendered pipe tables: exactly the rows they came from."""
    t = markdown.blocks(_nation_docs(spark, sf)).where("kind = 'table'")
    return t.select("doc_id", F.explode(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))).alias("r")).select("doc_id", F.col("r")[0].alias("id"), F.col("r")[1].alias("name"))


@query(rf"""WITH {NATIONS_SQL} SELECT CAST(k AS BIGINT) AS doc_id, 'table_note.orphan' AS code, CAST(NULL AS BIGINT) AS table_id, '' AS label FROM n
 UNION ALL SELECT k, 'table_note.duplicate_label', 1, 'a' FROM n WHERE k % 4 = 1""")
def md_note_findings(spark, sf):
    """Orphan notes, labels given twice, markers without a note."""
    return B.note_findings(B.table_notes(markdown.blocks(_nation_docs(spark, sf))))


@query(rf"""WITH {NATIONS_SQL} SELECT CAST(k AS BIGINT) AS doc_id, 'Of ' || n_name || '. more' AS abstract FROM n""")
def md_abstract(spark, sf):
    """Text of the abstract."""
    return B.abstract(markdown.blocks(_nation_docs(spark, sf))).where("in_abstract").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), " ").alias("abstract"))


@query(rf"""WITH {NATIONS_SQL} SELECT CAST(k AS BIGINT) AS doc_id, CASE WHEN k % 2 = 0 THEN 'Figure 1. Map ' || k || '.' ELSE 'alt ' || k END AS caption, k % 2 = 0 AS consumed FROM n""")
def md_image_captions(spark, sf):
    """Visible captions of images."""
    return B.image_captions(markdown.blocks(_nation_docs(spark, sf))).select("doc_id", "caption", "consumed")


@query(rf"""WITH {NATIONS_SQL} SELECT CAST(k AS BIGINT) AS doc_id, 'table ' || (k + 1) AS label, false AS duplicate FROM n WHERE k % 3 = 0""")
def md_reserved_labels(spark, sf):
    """Authored table labels."""
    return B.reserved_labels(markdown.blocks(_nation_docs(spark, sf)))


@query(rf"""WITH {NATIONS_SQL} SELECT CAST(k AS BIGINT) AS doc_id, CAST(1 AS INTEGER) AS ordinal, 'Abstract' AS heading, CAST(1 AS INTEGER) AS level, CAST(1 AS INTEGER) AS start_line, CAST(7 AS INTEGER) AS end_line FROM n
 UNION ALL SELECT k, 2, n_name, 1, 8, 13 + c + 1 + CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END + 3 + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END + 18 FROM n""")
def md_sections(spark, sf):
    """Sections and their lines."""
    return N.sections(N.lines(_nation_docs(spark, sf)))


@query(rf"""WITH {NATIONS_SQL} SELECT CAST(k AS BIGINT) AS doc_id, p.part, CAST(p.a AS INTEGER) AS start_line, p.error, CASE WHEN p.part = 'front' THEN CAST(7 AS BIGINT) END AS n_lines
 FROM n, (VALUES ('front', 1, CAST(NULL AS VARCHAR)), ('gone', NULL, 'missing')) AS p(part, a, error)""")
def md_split_sections(spark, sf):
    """Named parts of documents by headings; a heading that is not there is an error row."""
    docs = _nation_docs(spark, sf)
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), "n_name")
    none = F.lit(None).cast("int")
    front = names.select("doc_id", F.lit("front").alias("part"), F.lit("ABSTRACT:").alias("start"), none.alias("start_occurrence"), F.col("n_name").alias("end"), none.alias("end_occurrence"))
    gone = names.select("doc_id", F.lit("gone").alias("part"), F.lit("Abstract").alias("start"), F.lit(2).alias("start_occurrence"), F.lit(None).cast("string").alias("end"), none.alias("end_occurrence"))
    cut = N.split_sections(N.lines(docs), front.unionByName(gone))
    return cut.select("doc_id", "part", "start_line", "error", F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1)).cast("long")).alias("n_lines"))


@query(rf"""WITH {NATIONS_SQL} SELECT CAST(k AS BIGINT) AS doc_id, 'same' AS status FROM n""")
def md_round_trip(spark, sf):
    """Blocks rendered as Markdown and read again say the same."""
    b = markdown.blocks(_nation_docs(spark, sf)).select("*").withColumn("options", F.map_filter("options", lambda k, _: k.isin("caption_label", "label")))
    again = markdown.blocks(B.render_markdown(markdown.blocks(_nation_docs(spark, sf))).withColumnRenamed("markdown", "text")).withColumn("options", F.map_filter("options", lambda k, _: k.isin("caption_label", "label")))
    return B.compare(b, again)


@query(r"""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'T ' || n_name AS title, 'A' || n_nationkey AS authors, ['a' || n_nationkey || '@x.org'] AS contacts FROM nation""")
def front_matter(spark, sf):
    """Heading-keyed front matter as one row a document."""
    k = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("# Title\nT "), "n_name", F.lit("\n# AUTHOR:\nA"), k, F.lit("\n*a"), k, F.lit("@x.org\n# Other\nnot this"))
    docs = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))
    return N.front_matter(N.lines(docs)).select("doc_id", "title", "authors", F.transform("contacts", lambda c: F.regexp_replace(c, r"^\*", "")).alias("contacts"))


@query(r"""SELECT o_orderkey AS doc_id, k.kind, CAST(k.n AS BIGINT) AS n FROM orders,
 LATERAL (VALUES ('text', 4 + (o_orderkey % 5 < 2)::INT), ('strong', 1), ('emph', 1), ('code', (o_orderkey % 2 = 0)::INT), ('math', (o_orderkey % 3 = 0)::INT), ('citation', 1), ('link', (o_orderkey % 5 < 2)::INT), ('sub', 1)) AS k(kind, n) WHERE k.n > 0""")
def inline_trees(spark, sf):
    """Inline nodes by kind."""
    k = F.col("o_orderkey")
    parts = [
        F.lit("**a *b"), F.col("o_custkey"), F.lit("***"), F.when(k % 2 == 0, F.concat(F.lit("`c"), k, F.lit("`"))).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("$d_"), k, F.lit("$"))).otherwise(""),
        F.lit("\\cite{e, f"), k, F.lit("}"), F.when(k % 5 < 2, "[g](h)").otherwise(""), F.lit("x_2<sub>i</sub>"),
    ]
    docs = table(spark, sf, "orders").select(k.alias("doc_id"), F.concat(*parts).alias("text"))
    return inline.inline_nodes(docs, ["doc_id"]).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT c_custkey AS doc_id, 'Customer ' || c_custkey || ' a-b' AS key FROM customer""")
def inline_keys(spark, sf):
    """Matching keys: markup, list numbers, dashes and spacing do not count."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), inline.inline_key(F.concat(F.lit("3. **Customer**   "), "c_custkey", F.lit(" *a*–b"))).alias("key"))


# -- TeX -----------------------------------------------------------------------------------
def _tex_docs(spark, sf) -> DataFrame:
    k = F.col("n_nationkey")
    text = F.concat(F.lit("\\section{"), "n_name", F.lit("}\\label{sec:a}\nSome \\textbf{bold} 5\\% text % not this\n\n\\begin{itemize}\\item x\\item y\\end{itemize}\n\\begin{table}\\caption{C}\\label{tab:t}\\begin{tabular}{ll}1 & "), k, F.lit("\\\\ 2 & z\\\\\\end{tabular}\\end{table}\n\\begin{equation}\\label{eq:e}a=b\\end{equation}\\begin{align*}\\label{eq:no}x\\end{align*}\n\\begin{figure}\\label{fig:f}\\end{figure}\\begin{weird}q\\end{weird}\\section{Two}\\subsection{S}\\label{sec:b}"))
    return table(spark, sf, "nation").select(k.cast("long").alias("doc_id"), text.alias("text"))


@query(r"""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(b.i AS INTEGER) AS ordinal, b.kind, CASE b.i WHEN 0 THEN n_name ELSE b.t END AS text, b.code FROM nation, (VALUES (0,'heading','',NULL),(1,'paragraph','Some bold 5% text',NULL),(2,'bullet','x',NULL),(3,'bullet','y',NULL),
 (4,'table_caption','C',NULL),(5,'table','',NULL),(6,'equation','a=b',NULL),(7,'equation',E'\\begin{align*}\nx\n\\end{align*}',NULL),(8,'image','','resource.missing'),(9,'opaque','q','latex.unsupported_environment'),(10,'heading','Two',NULL),(11,'heading','S',NULL)) AS b(i,kind,t,code)""")
def tex_blocks(spark, sf):
    """Blocks of rendered TeX, with codes for what has no block."""
    return latex.blocks(_tex_docs(spark, sf)).select("doc_id", "ordinal", "kind", "text", "code")


@query(r"""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, l.label, l.kind, l.value FROM nation, (VALUES ('sec:a','section','1'),('tab:t','table','1'),('eq:e','equation','1'),('fig:f','figure','1'),('sec:b','subsection','2.1')) AS l(label,kind,value)""")
def tex_labels(spark, sf):
    """Numbers that counters give to labels."""
    return latex.labels(_tex_docs(spark, sf))


@query(r"""SELECT label, value, source FROM (SELECT 'n' || n_nationkey AS label, CAST(n_nationkey AS VARCHAR) AS value, 'main' AS source FROM nation WHERE n_nationkey < 15
 UNION ALL SELECT 'n' || n_nationkey, 'S' || n_nationkey, 'aux' FROM nation WHERE n_nationkey >= 15 UNION ALL SELECT 'S-n' || n_nationkey, 'S' || n_nationkey, 'aux' FROM nation WHERE n_nationkey >= 10)""")
def label_index(spark, sf):
    """Labels of a document and its supplement, the document's first."""
    n = table(spark, sf, "nation")
    main = n.where("n_nationkey < 15").select(F.concat(F.lit("n"), "n_nationkey").alias("label"), F.col("n_nationkey").cast("string").alias("value"))
    aux = n.where("n_nationkey >= 10").select(F.concat(F.lit("n"), "n_nationkey").alias("label"), F.concat(F.lit("S"), "n_nationkey").alias("value"))
    return C.label_index(main, aux)


# -- citations: document = order, key = part, position = line ----------------------------------
CITED_SQL = "c AS (SELECT l_orderkey AS doc_id, 'p' || (l_partkey % 40) AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position FROM lineitem), f AS (SELECT doc_id, key, min(position) AS position FROM c GROUP BY ALL)"


def _cite_docs(spark, sf) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    text = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("Text \\cite{ p"), r["l_partkey"] % 40, F.lit("}."))), " ")
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(text.alias("text"))


@query(f"WITH {CITED_SQL} SELECT doc_id, CAST(position AS INTEGER) AS position, key FROM c")
def cite_scan(spark, sf):
    """Cited keys in reading order."""
    return C.scan(_cite_docs(spark, sf))


@query(f"WITH {CITED_SQL} SELECT DISTINCT doc_id, key FROM c WHERE CAST(substr(key, 2) AS INTEGER) >= 35")
def cite_unknown(spark, sf):
    """Keys that the bibliography lacks."""
    bib = spark.range(35).select(F.concat(F.lit("p"), "id").alias("key"))
    return C.unknown_keys(C.scan(_cite_docs(spark, sf)), bib)


PLAN_SQL = " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {first}) AS INTEGER) AS ordinal, key, {label} AS label, {has} AS inherited FROM f"


@query(f"WITH {CITED_SQL}" + PLAN_SQL.format(first="position", label="CAST(row_number() OVER (PARTITION BY doc_id ORDER BY position) AS VARCHAR)", has="false"))
def cite_plan(spark, sf):
    """Numbers by first citation."""
    return C.plan(C.scan(_cite_docs(spark, sf)))


_HAS = "CAST(substr(key, 2) AS INTEGER) % 7 = 0"


@query(f"WITH {CITED_SQL}" + PLAN_SQL.format(first=f"NOT ({_HAS}), position", label=f"CASE WHEN {_HAS} THEN CAST(CAST(substr(key, 2) AS INTEGER) + 1 AS VARCHAR) ELSE 'S' || row_number() OVER (PARTITION BY doc_id, {_HAS} ORDER BY position) END", has=_HAS))
def cite_plan_inherited(spark, sf):
    """Numbers under an inherited map."""
    known = spark.range(0, 40, 7).select(F.concat(F.lit("p"), "id").alias("key"), (F.col("id") + 1).alias("number"))
    return C.plan(C.scan(_cite_docs(spark, sf)), inherited=known)


@query(f"WITH {CITED_SQL}" + PLAN_SQL.format(first="CAST(substr(key, 2) AS INTEGER)", label="'R' || row_number() OVER (PARTITION BY doc_id ORDER BY CAST(substr(key, 2) AS INTEGER))", has="false"))
def cite_plan_source_order(spark, sf):
    """Numbers by the bibliography's order, with a prefix."""
    bib = spark.range(40).select(F.concat(F.lit("p"), "id").alias("key"), F.col("id").alias("ordinal"))
    return C.plan(C.scan(_cite_docs(spark, sf)), bib=bib, numbering="source-order", prefix="R")


RUNS_SQL = """d AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey % 12 AS n FROM lineitem), g AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM d),
 r AS (SELECT doc_id, min(n) AS a, max(n) AS b, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS every FROM g GROUP BY doc_id, g)"""


def _labels(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list((F.col("l_suppkey") % 12).cast("string")).alias("labels"))


@query(f"WITH {RUNS_SQL} SELECT doc_id, '[' || string_agg(CASE WHEN b - a >= 2 THEN a || '–' || b ELSE every END, ',' ORDER BY a) || ']' AS label FROM r GROUP BY doc_id")
def ranges_bracketed(spark, sf):
    """Sorted labels, ranges from three, in brackets."""
    return _labels(spark, sf).select("doc_id", ranges.bracketed(F.col("labels")).alias("label"))


@query(f"WITH {RUNS_SQL} SELECT doc_id, string_agg(CASE WHEN b > a THEN a || '–' || b ELSE every END, ',' ORDER BY a) AS label FROM r GROUP BY doc_id")
def ranges_sorted_pairs(spark, sf):
    """Sorted labels, ranges from two."""
    return _labels(spark, sf).select("doc_id", ranges.sorted_pairs(F.col("labels")).alias("label"))


@query(f"WITH {RUNS_SQL} SELECT doc_id, CASE WHEN b > a THEN a || '–' || b ELSE every END AS text, CAST(a AS VARCHAR) AS link FROM r")
def ranges_linked(spark, sf):
    """Parts of a label and the reference each links to."""
    return _labels(spark, sf).select("doc_id", F.explode(ranges.linked_parts(F.col("labels"))).alias("p")).select("doc_id", "p.text", "p.link")


@query(f"""WITH {RUNS_SQL} SELECT doc_id, list(n ORDER BY n)::BIGINT[] AS numbers FROM d GROUP BY doc_id""")
def ranges_round_trip(spark, sf):
    """Numbers of a label read back."""
    shown = ranges.in_order(F.array_sort(F.array_distinct(F.transform("labels", lambda x: x.cast("long")))))
    return _labels(spark, sf).select("doc_id", ranges.numbers_of(shown).alias("numbers"))


@query(r"""SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS ordinal, CAST(l_linenumber + 1 AS INTEGER) AS number, true AS moved FROM (SELECT DISTINCT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE k = l_linenumber
 UNION ALL SELECT l_orderkey, CAST(l_linenumber AS INTEGER), CAST(k + 1 AS INTEGER), true FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE k <> l_linenumber""")
def table_numbers(spark, sf):
    """Automatic table numbers that step over an authored Table 1."""
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ordinal")).distinct()
    return C.next_numbers(t, t.select("doc_id").distinct().withColumn("label", F.lit("Table  1")))


# -- bibliographies ---------------------------------------------------------------------------
def _bib_docs(spark, sf) -> DataFrame:
    text = F.concat(F.lit("@string{pub = {Press}}\n@article{p"), "p_partkey", F.lit(",\n title = {On {"), "p_name", F.lit("}}, author = \"A, B and "), "p_brand", F.lit(" and others\",\n journal = pub # { of "), "p_type", F.lit("}, year = "), F.col("p_size") + 1960, F.lit(", junk, volume={7}}\n@book{x"), F.col("p_partkey"), F.lit(", title={first}}\n@book{x"), F.col("p_partkey"), F.lit(", title={last}}"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@query(r"""SELECT p_partkey AS doc_id, CAST(0 AS INTEGER) AS ordinal, 'p' || p_partkey AS key, 'article' AS entry_type, 'On {' || p_name || '}' AS title, 'Press of ' || p_type AS journal, CAST(p_size + 1960 AS VARCHAR) AS year FROM part
 UNION ALL SELECT p_partkey, 1, 'x' || p_partkey, 'book', 'last', NULL, NULL FROM part""")
def bib_entries(spark, sf):
    """BibTeX records: macros, concatenation, malformed fields, repeated keys."""
    e = bibtex.entries(bibtex.bibtex(_bib_docs(spark, sf)))
    return e.select("doc_id", "ordinal", "key", "entry_type", *(F.col("fields")[k].alias(k) for k in ("title", "journal", "year")))


def _entries(spark, sf) -> DataFrame:
    k = F.col("p_partkey") % 4
    fields = F.create_map(F.lit("author"), F.concat(F.col("p_brand"), F.lit(" and others")), F.lit("title"), F.col("p_name"), F.lit("journal"), F.when(k != 1, F.col("p_type")).otherwise(""), F.lit("year"), F.when(k == 3, "in press").otherwise((F.col("p_size") + 1960).cast("string")), F.lit("pages"), F.when(k == 2, "1-9").otherwise(""), F.lit("volume"), F.when(k == 2, "7").otherwise(""), F.lit("doi"), F.concat(F.lit("doi:10.1/"), "p_partkey"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), fields.alias("fields"))


@query(r"""SELECT p_partkey AS doc_id, p_brand || ' et al.' || ' ' || p_name || CASE WHEN p_name LIKE '%.' THEN '' ELSE '.' END || ' ' || CASE p_partkey % 4 WHEN 1 THEN '(' || (p_size + 1960) || ').' WHEN 2 THEN p_type || ' 7, 1-9 (' || (p_size + 1960) || ').'
 WHEN 3 THEN p_type || ' (in press).' ELSE p_type || ' (' || (p_size + 1960) || ').' END || ' https://doi.org/10.1/' || p_partkey AS reference FROM part""")
def bib_plain(spark, sf):
    """Reference strings of the plain profile."""
    return _entries(spark, sf).select("doc_id", biblio.format_entry(F.col("fields"), "plain").alias("reference"))


@query(r"""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 IN (0, 2) THEN p_brand || ' et al. ' || p_name || CASE WHEN p_name LIKE '%.' THEN '' ELSE '.' END || ' *' || p_type || '*, **' || (p_size + 1960) || '**' || CASE p_partkey % 4 WHEN 2 THEN ', *7*, 1-9.' ELSE '. DOI: 10.1/' || p_partkey END END AS reference,
 CASE p_partkey % 4 WHEN 1 THEN 'venue' WHEN 3 THEN 'year' END AS error FROM part""")
def bib_markdown(spark, sf):
    """Reference strings of the Markdown profile, and why there is none."""
    return _entries(spark, sf).select("doc_id", biblio.format_entry(F.col("fields"), "markdown").alias("reference"), biblio.markdown_error(F.col("fields")).alias("error"))


@query(r"""SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 WHEN 1 THEN s_name || ' & Bo' WHEN 2 THEN s_name || ' et al.' ELSE s_name END AS short, CASE s_suppkey % 4 WHEN 0 THEN s_name ELSE s_name || ', and Bo' END AS listed FROM supplier""")
def bib_authors(spark, sf):
    """Short and listed authors."""
    k = F.col("s_suppkey") % 4
    raw = F.concat(F.col("s_name"), F.lit(", X"), F.when(k == 1, " and Bo, Y").when(k == 2, " and Bo, Y and Cy, Z").when(k == 3, " and others").otherwise(""))
    names = F.when(k == 0, F.array(F.col("s_name"))).otherwise(F.array(F.col("s_name"), F.lit(" Bo ")))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), biblio.author_short(raw).alias("short"), biblio.author_list(names).alias("listed"))


# -- summaries ------------------------------------------------------------------------------------
@query("SELECT event_type, user_id % 3 AS kind, median(value) AS value, count(*) AS runs FROM events GROUP BY ALL")
def median_rows(spark, sf):
    """Exact medians by operation and kind."""
    return A.median_rows(table(spark, sf, "events").select("event_type", (F.col("user_id") % 3).alias("kind"), "value"), ["event_type", "kind"], ["value"])


@query("""WITH g AS (SELECT l_orderkey, l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS l_quantity, min(l_linenumber) AS o FROM lineitem GROUP BY ALL)
 SELECT l_orderkey, l_returnflag, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, o, l_returnflag) AS r FROM g) WHERE r = 1""")
def weighted_mode(spark, sf):
    """The value of most weight, the earliest of equals."""
    return A.weighted_mode(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", "l_quantity", "l_linenumber")


@query("""WITH g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(o_orderkey) AS o FROM orders GROUP BY ALL)
 SELECT o_orderpriority, o_orderstatus, n, o_orderpriority || CASE WHEN r = 1 THEN '' ELSE '-' || r END AS name FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o) AS r FROM g)""")
def class_names(spark, sf):
    """Looks of a style, named by how common they are."""
    return A.class_names(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "o_orderkey")


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
 SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last FROM e GROUP BY user_id, event_type, g HAVING count(*) > 1""")
def merged_runs(spark, sf):
    """Runs of equal neighbours."""
    return A.merged_runs(table(spark, sf, "events"), ["user_id"], "event_id", "event_type")


@query("""WITH c AS (SELECT p_brand, 1 AS col, max(length(p_name)) AS len FROM part GROUP BY ALL UNION ALL SELECT p_brand, 2, max(length(p_type)) FROM part GROUP BY ALL UNION ALL SELECT p_brand, 3, max(length(CAST(p_size AS VARCHAR))) FROM part GROUP BY ALL),
 s AS (SELECT *, greatest(240, CAST(round_even(9000.0 * len / sum(len) OVER (PARTITION BY p_brand), 0) AS BIGINT)) AS w FROM c)
 SELECT p_brand, CAST(col AS INTEGER) AS col, CAST(CASE WHEN col = 3 THEN greatest(240, 9000 - sum(CASE WHEN col < 3 THEN w ELSE 0 END) OVER (PARTITION BY p_brand)) ELSE w END AS BIGINT) AS width FROM s""")
def column_widths(spark, sf):
    """Column widths by longest text."""
    cells = table(spark, sf, "part").select("p_brand", F.posexplode(F.array("p_name", "p_type", F.col("p_size").cast("string"))).alias("col", "value")).withColumn("col", F.col("col") + 1)
    return A.column_widths(cells, ["p_brand"], "col", "value", 9000)


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, c.col AS column, CASE c.col WHEN 0 THEN n_name WHEN 1 THEN 'Size mean' ELSE 'Size sd' END AS header FROM nation, (VALUES (CAST(0 AS INTEGER)), (1), (2)) AS c(col)""")
def flat_headers(spark, sf):
    """Two header rows as one."""
    cells = F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("column"), F.lit(w).alias("colspan"), t.alias("text")) for r, c, w, t in ((0, 0, 1, F.col("n_name")), (0, 1, 2, F.lit("Size")), (1, 0, 1, F.lit("")), (1, 1, 1, F.lit("mean")), (1, 2, 1, F.lit("sd")))))
    return A.flatten_header(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.explode(cells).alias("c")).select("doc_id", "c.*"))


@query("""WITH f AS (SELECT source, doc_id || '.txt' AS path, length(text) AS size, sha256(text) AS sha FROM documents),
 b AS (SELECT source, substr(sha256(path), 1, 3) AS bucket, count(*) AS n, sum(size) AS size, sha256(string_agg(sha || ' ' || size || ' ' || path, chr(10) ORDER BY path)) AS part FROM f GROUP BY ALL)
 SELECT source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS bytes, sha256(string_agg(part, chr(10) ORDER BY bucket)) AS semantic_hash FROM b GROUP BY source""")
def manifests(spark, sf):
    """Artifacts of each source with one hash over all."""
    docs = table(spark, sf, "documents").select("source", F.concat("doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return A.manifest(docs.select("source", "path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256")), "source")


@query("""SELECT doc_id || '.txt' AS path, CASE doc_id % 5 WHEN 0 THEN 'artifact.missing' WHEN 1 THEN 'artifact.size' ELSE 'artifact.sha256' END AS code FROM documents WHERE doc_id % 5 < 3""")
def changed_artifacts(spark, sf):
    """Recorded artifacts that are gone or differ."""
    d = table(spark, sf, "documents").select("doc_id", F.concat("doc_id", F.lit(".txt")).alias("path"), "text")
    k = F.col("doc_id") % 5
    now = d.where(k != 0).select("path", F.when(k == 1, F.concat("text", F.lit("+"))).when(k == 2, F.concat(F.substring("text", 1, 1 << 30), F.lit(""))).otherwise(F.col("text")).alias("content"), "doc_id")
    now = now.withColumn("content", F.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("\u0001"), F.substring("content", 2, 1 << 30))).otherwise(F.col("content")))
    return A.changed(A.artifacts(d.withColumnRenamed("text", "content")), A.artifacts(now))


@query("""SELECT doc_id, sha256(text) || '  d/' || doc_id AS line, sha256(text) AS sha256, upper(substr(sha1(text), 1, 8)) AS id FROM documents""")
def checksums(spark, sf):
    """Checksum lines, read back, and stable ids."""
    line = A.checksum_line(F.sha2("text", 256), F.concat(F.lit("d/"), "doc_id"))
    return table(spark, sf, "documents").select("doc_id", line.alias("line"), A.parse_checksum(line)["sha256"].alias("sha256"), A.stable_id(F.col("text")).alias("id"))


@query("""SELECT 'n' || n_nationkey AS style, p.property, CASE p.property WHEN 'size' THEN CASE WHEN n_nationkey % 2 = 0 THEN 'own' ELSE r_name END ELSE 'base' END AS value FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('size'), ('font')) AS p(property)
 UNION ALL SELECT 'r' || r_regionkey, p.property, CASE p.property WHEN 'size' THEN r_name ELSE 'base' END FROM region, (VALUES ('size'), ('font')) AS p(property) UNION ALL SELECT 'root', 'font', 'base'""")
def resolved_styles(spark, sf):
    """Properties along chains of styles, the nearest first."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    styles = n.select(F.concat(F.lit("n"), "n_nationkey").alias("style"), F.concat(F.lit("r"), "n_regionkey").alias("based_on")).unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("style"), F.lit("root").alias("based_on"))).unionByName(spark.range(1).select(F.lit("root").alias("style"), F.lit(None).cast("string").alias("based_on")))
    props = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("style"), F.lit("size").alias("property"), F.lit("own").alias("value")).unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("style"), F.lit("size").alias("property"), F.col("r_name").alias("value"))).unionByName(spark.range(1).select(F.lit("root").alias("style"), F.lit("font").alias("property"), F.lit("base").alias("value")))
    return A.resolved_styles(styles, props)


@query("""SELECT p_partkey AS doc_id, 'a=' || p_size || ' c=3' AS merged, '-b@x=0 a=' || p_size || ' c=3' AS override FROM part""")
def property_maps(spark, sf):
    """Overrides of property maps: the least one found, and what it gives."""
    base = F.create_map(F.lit("a"), F.lit("old"), F.lit("b@x"), F.lit("1"))
    target = F.create_map(F.lit("a"), F.col("p_size").cast("string"), F.lit("c"), F.lit("3"))
    d = A.diff_properties(base, target)
    shown = A.format_properties(F.transform_values(d, lambda k, v: F.when(k.startswith("-"), "0").otherwise(v)))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), A.format_properties(A.merge_properties(base, d)).alias("merged"), shown.alias("override"))


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_size % 3 = 0 THEN p_name || ' level' ELSE p_type END AS header, p_size % 3 = 0 AS grouping FROM part""")
def grouping_headers(spark, sf):
    """Headers under which equal neighbours are one group."""
    h = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" level"))).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), h.alias("header"), A.is_grouping(h).alias("grouping"))


@query("""SELECT p_partkey AS doc_id, 'Cap ' || p_name AS text, 'page' AS span, CASE WHEN p_size % 2 = 0 THEN 'conflict' END AS error FROM part""")
def caption_markers(spark, sf):
    """Layout marks at a caption's end."""
    c = F.concat(F.lit("Cap "), "p_name", F.lit("|span=page"), F.when(F.col("p_size") % 2 == 0, "|span=column").otherwise("|grouping=off"))
    m = T.caption_markers(c)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), m["text"].alias("text"), F.coalesce(m["markers"]["span"], F.lit("page")).alias("span"), m["error"].alias("error"))


# -- versions ---------------------------------------------------------------------------------------
def _versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.lit("p").alias("kind"), F.col("role").alias("style"), "text")
    return t, t.where("ordinal % 3 <> 1").withColumn("text", F.when(F.col("ordinal") % 4 == 0, F.concat("text", F.lit(" indeed"))).otherwise(F.col("text")))


@query()
def align_versions(spark, sf):
    """Edits between two versions of conversations; tests replay them."""
    return L.align_versions(*_versions(spark, sf))


@query()
def change_summary(spark, sf):
    """Counts of edits."""
    return L.change_summary(L.align_versions(*_versions(spark, sf)))


@query("""SELECT conv_id AS doc_id, turn AS ordinal, CASE turn % 3 WHEN 0 THEN text || ' indeed' WHEN 1 THEN 'So ' || text ELSE text || ' ' || turn || ' ' || text END AS accepted, text AS rejected,
 text AS kept, CAST(2 AS INTEGER) AS n_edits FROM conversations""")
def redline(spark, sf):
    """Word edits, taken and refused; what is kept is the whole text, as one run."""
    k, t = F.col("turn"), F.col("text")
    new = F.when(k % 3 == 0, F.concat(t, F.lit(" indeed"))).when(k % 3 == 1, F.concat(F.lit("So "), t)).otherwise(F.concat_ws(" ", t, k, t))
    pairs = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), k.alias("ordinal"), t.alias("base_text"), new.alias("current_text"))
    e = F.col("edits")
    kept = F.array_join(F.transform(F.filter(e, lambda x: x["op"] == "equal"), lambda x: x["text"]), "")
    return L.redline(pairs).select("doc_id", "ordinal", L.accepted(e).alias("accepted"), L.rejected(e).alias("rejected"), kept.alias("kept"), F.size(e).alias("n_edits"))


@query("""SELECT conv_id AS doc_id, turn AS anchor, CASE WHEN turn % 3 = 1 THEN 'removed' WHEN turn % 4 = 0 THEN 'changed' ELSE 'same' END AS status FROM conversations""")
def anchor_changes(spark, sf):
    """Changes by anchor."""
    a, b = (v.withColumn("anchor", F.col("ordinal")) for v in _versions(spark, sf))
    return L.anchor_changes(a, b)


@query(r"""SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS left_ordinal, CAST(turn AS BIGINT) AS right_ordinal, CAST(round(2.0 * n / (2 * n + 7), 6) AS DOUBLE) AS ratio FROM
 (SELECT conv_id, turn, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS r FROM conversations) WHERE r = 1 AND n >= 200""")
def nearest_text(spark, sf):
    """Each longer text's most similar one among edited texts: its own, by how little the edit is."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), "text")
    first = t.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("ordinal"))).where("r = 1").drop("r")
    long_ = first.where(F.length(T.squeeze(F.col("text"))) >= 200)
    return L.nearest_text(long_, first.withColumn("text", F.concat("text", F.lit(" indeed"))), least=0.9)


@query("""SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS source_ordinal, CAST(turn AS BIGINT) AS target_ordinal FROM conversations WHERE turn % 3 <> 1""")
def map_blocks(spark, sf):
    """Blocks of a source matched to those of an edited target, in order."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.concat("turn", F.lit(" of the conversation: "), "text").alias("key"))
    return D.map_blocks(t, t.where("ordinal % 3 <> 1").withColumn("key", F.when(F.col("ordinal") % 3 == 2, F.concat("key", F.lit("!"))).otherwise(F.col("key"))))


@query("""SELECT conv_id AS doc_id, CASE WHEN turn = 0 THEN 'refused' ELSE 'replace' END AS op, CAST(turn AS BIGINT) AS baseline_ordinal, CAST(turn AS BIGINT) AS edited_ordinal, turn || ' ' || text || '?' AS text
 FROM conversations WHERE turn % 2 = 0""")
def plan_delta(spark, sf):
    """Replacements that an edit asks for; opaque chunks are refused."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), (F.col("turn") == 0).alias("opaque"), F.concat("turn", F.lit(" "), "text").alias("text"))
    return D.plan_delta(t, t.withColumn("text", F.when(F.col("ordinal") % 2 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, c.code, c.part, CAST(c.l AS INTEGER) AS line_no FROM nation, (VALUES ('chunk.overlap', 'b', 2), ('chunk.uncovered', NULL, 5)) AS c(code, part, l)""")
def line_chunk_faults(spark, sf):
    """Ranges of lines that overlap, and lines that none covers."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit("a\nb\nc\n\nd").alias("text"))
    r = n.select("doc_id", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(a).alias("first"), F.lit(b).alias("last")) for p, a, b in (("a", 1, 2), ("b", 2, 3))))).alias("r")).select("doc_id", "r.*")
    return D.line_chunks(N.lines(n), r)[1]


@query("""SELECT s_suppkey AS doc_id, 'see S' || s_suppkey || '–S' || (s_suppkey + 3) || ', 1, 3 and 4' AS text FROM supplier""")
def listed_numbers(spark, sf):
    """Numbers listed in prose as ranges."""
    k = F.col("s_suppkey")
    raw = F.concat(F.lit("see S"), k, F.lit(", S"), k + 1, F.lit(", S"), k + 2, F.lit(" and S"), k + 3, F.lit(", 1, 3 and 4"))
    return table(spark, sf, "supplier").select(k.alias("doc_id"), D.collapse_lists(raw).alias("text"))


@query("""SELECT g AS doc_id, p_partkey AS ordinal, word || (1990 + p_size % 30) || CASE WHEN k = 1 THEN '' ELSE chr(CAST(95 + k AS INTEGER)) END AS key FROM
 (SELECT *, row_number() OVER (PARTITION BY g, word, p_size % 30 ORDER BY p_partkey) AS k FROM (SELECT *, p_partkey // 100 AS g, split_part(p_name, ' ', 1) || CASE p_partkey % 3 WHEN 0 THEN 'e' ELSE '' END AS word FROM part))""")
def surname_keys(spark, sf):
    """Citation keys from reference texts: surnames with marks, behind and before initials."""
    k, first = F.col("p_partkey"), F.initcap(F.split("p_name", " ")[0])
    name = F.when(k % 3 == 0, F.concat(F.lit("[7] "), first, F.lit("é, X. Y."))).when(k % 3 == 1, F.concat(F.lit("A. B.-C. "), first, F.lit("; Other, D."))).otherwise(F.concat(first, F.lit(" Q., Z.")))
    text = F.concat(name, F.lit(" On things ("), 1990 + F.col("p_size") % 30, F.lit(")."))
    return D.surname_keys(table(spark, sf, "part").select(F.floor(k / 100).alias("doc_id"), k.alias("ordinal"), text.alias("text")))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(0 AS INTEGER) AS ordinal, n_name AS title, ['b' || n_nationkey] AS bullets, NULL::VARCHAR AS error FROM nation UNION ALL SELECT n_nationkey, 1, '', []::VARCHAR[], 'slides.title' FROM nation""")
def slides(spark, sf):
    """Slides of JSON lists, checked."""
    text = F.concat(F.lit('[{"title":" '), "n_name", F.lit(' ","bullets":["b'), "n_nationkey", F.lit('"]},{"title":""}]'))
    return files.slides(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text")))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'p.md' AS part, n_name AS start, CAST(2 AS INTEGER) AS start_occurrence, 'End' AS "end", CAST(1 AS INTEGER) AS end_occurrence FROM nation""")
def section_maps(spark, sf):
    """JSON section maps, with the old name of a key."""
    text = F.concat(F.lit('{"sections":[{"path":"p.md","start":{"heading":"'), "n_name", F.lit('","occurrence":2},"end":"End"}]}'))
    return files.section_map(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))).drop("kind")


@query(r"""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE '# ' || n_name || E'\n\n- x' END AS text, CAST(n_nationkey % 2 = 0 AS BIGINT) AS n_losses FROM nation""")
def convert(spark, sf):
    """TeX to Markdown; under the strict policy a loss keeps a document back."""
    text = F.concat(F.lit("\\section{"), "n_name", F.lit("}\\begin{itemize}\\item x\\end{itemize}"), F.when(F.col("n_nationkey") % 2 == 0, "\\begin{weird}y\\end{weird}").otherwise(""))
    return api.convert(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text")), "latex", "markdown", "error")


def queries() -> dict[str, Callable]:
    from . import catalog_review  # noqa: F401  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_review  # noqa: F401

    return dict(_SQL)
