"""From texts to lines, paragraphs, headings and sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: Callable[[Column], Column] | None = None, name: str = "raw") -> DataFrame:
    """doc_id, line_no (from 1) and the line, or what ``of`` makes of it. A generator over one projection: no shuffle.

    ``of`` is worked out before the lines become rows, so that a filter on it does not work it out again.
    """
    found = T.split_lines(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(found if of is None else F.transform(found, of)).alias("line_no", name))
    return rows.withColumn("line_no", F.col("line_no") + 1)


#: Stands between a line's number and the line while paragraphs are cut.
MARK = "\u0001"


def _paragraph_rows(text: Column) -> Column:
    """(start_line, end_line, raw) of the maximal runs of lines that hold more than white space.

    Lines are numbered and blank ones emptied, so paragraphs stand between runs of line ends: one
    split, in time and stack that do not depend on how long a paragraph is. A last line of the mark
    alone, which no numbered line can be, tells a paragraph that ends with the text.
    """
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)
    numbered = F.transform(lines, lambda x, i: F.when(x.rlike(r"\S"), F.concat((i + 1).cast("string"), F.lit(MARK), x)).otherwise(""))
    parts = F.split(F.concat(F.array_join(numbered, "\n"), F.lit("\n" + MARK)), r"\n{2,}", -1)
    bodies = F.transform(F.filter(parts, lambda p: ~p.isin("", MARK, "\n" + MARK)), lambda p: F.regexp_replace(p, r"\A\n", ""))
    ends = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))

    def row(p):
        first, last = F.substring_index(p, MARK, 1).cast("int"), p.endswith("\n" + MARK)
        raw = F.regexp_replace(p, rf"(?md)^[0-9]*{MARK}", "")
        whole = F.when(last, F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(F.concat(raw, F.lit("\n")))
        return F.struct(first.alias("start_line"), (first + ends(p) - last.cast("int")).alias("end_line"), whole.alias("raw"))

    return F.transform(bodies, row)


def source_map(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs with the hash of their raw lines: doc_id, paragraph, start_line, end_line, sha256, text.

    A document without paragraphs keeps one row with a null paragraph. Row-local: no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(~text.rlike(r"\S"), text).alias("blank"), F.posexplode_outer(_paragraph_rows(text)).alias("paragraph", "p"))
    return rows.select(
        "doc_id", "paragraph", F.coalesce("p.start_line", F.lit(1)).alias("start_line"), F.coalesce("p.end_line", F.lit(0)).alias("end_line"),
        F.sha2(F.coalesce("p.raw", "blank"), 256).alias("sha256"), F.coalesce(F.regexp_replace("p.raw", r"\n\z", ""), F.lit("")).alias("text"),
    )


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blank-line chunks: doc_id, ordinal, opaque (a table or an image alone), text."""
    parts = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n\s*\n"), lambda x: T.strip(x) != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("ordinal", "raw"))
    of = T.split_lines(T.strip(F.col("raw")))
    opaque = F.forall(of, lambda x: T.strip(x).startswith("|")) | ((F.size(of) == 1) & T.strip(F.col("raw")).rlike(r"^!\[[^\]]*\]\([^)]+\)$"))
    return rows.select("doc_id", "ordinal", opaque.alias("opaque"), F.when(opaque, F.col("raw")).otherwise(T.squeeze(F.col("raw"))).alias("text"))


def headings(lines_df: DataFrame) -> DataFrame:
    """doc_id, line_no, level, heading and which occurrence of that heading in its document it is."""
    h = lines_df.select("doc_id", "line_no", T.heading_level(F.col("raw")).alias("level"), T.heading_text(F.col("raw")).alias("heading")).where("heading is not null")
    return h.withColumn("occurrence", F.row_number().over(Window.partitionBy("doc_id", F.lower("heading")).orderBy("line_no")))


def sections(lines_df: DataFrame) -> DataFrame:
    """Each heading's section: doc_id, ordinal, heading, level, start_line, end_line (the line before the next heading)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    last = lines_df.groupBy("doc_id").agg(F.max("line_no").alias("n"))
    h = headings(lines_df).select("doc_id", "line_no", "level", "heading", F.row_number().over(w).alias("ordinal"), F.lead("line_no").over(w).alias("next"))
    return h.join(last, "doc_id").select("doc_id", "ordinal", "heading", "level", F.col("line_no").alias("start_line"), F.coalesce(F.col("next") - 1, "n").alias("end_line"))


def split_sections(lines_df: DataFrame, section_map: DataFrame) -> DataFrame:
    """Lines of the ranges that ``section_map(doc_id, part, start, start_occurrence, end, end_occurrence)`` names.

    doc_id, part, start_line, end_line (exclusive), error, text. Headings compare without case; a
    null start is the first line and a null end is past the last. Errors: missing, empty, overlap.
    """
    h = headings(lines_df).select("doc_id", F.lower("heading").alias("k"), F.col("occurrence").alias("o"), "line_no")
    n = lines_df.groupBy("doc_id").agg((F.max("line_no") + 1).alias("past"))

    def at(df, side):
        key = h.select("doc_id", F.col("k").alias(f"{side}_k"), F.col("o").alias(f"{side}_o"), F.col("line_no").alias(f"{side}_line"))
        return df.withColumn(f"{side}_k", F.lower(F.regexp_replace(T.strip(F.col(side)), ":+$", ""))).withColumn(f"{side}_o", F.coalesce(f"{side}_occurrence", F.lit(1))).join(key, ["doc_id", f"{side}_k", f"{side}_o"], "left")

    found = at(at(section_map.join(n, "doc_id"), "start"), "end")
    placed = found.select("doc_id", "part", F.when(F.col("start").isNull(), 1).otherwise(F.col("start_line")).alias("a"), F.when(F.col("end").isNull(), F.col("past")).otherwise(F.col("end_line")).alias("b"))
    w = Window.partitionBy("doc_id").orderBy("a", "part").rowsBetween(Window.unboundedPreceding, -1)
    marked = placed.withColumn("error", F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("b") <= F.col("a"), "empty").when(F.max(F.when(F.col("a").isNotNull(), F.col("b"))).over(w) > F.col("a"), "overlap"))
    body = marked.join(lines_df, "doc_id").where("line_no >= a and line_no < b").groupBy("doc_id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n").alias("text"))
    return marked.join(body, ["doc_id", "part"], "left").select("doc_id", "part", F.col("a").alias("start_line"), F.col("b").alias("end_line"), "error", "text")


def normalise_headings(lines_df: DataFrame, first_level: int = 1) -> DataFrame:
    """Lines with a document's first heading at first_level and later ones one deeper, at most 6."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    h = lines_df.withColumn("heading", T.heading_text(F.col("raw")))
    level = F.when(F.coalesce(F.sum(F.col("heading").isNotNull().cast("int")).over(w), F.lit(0)) == 0, first_level).otherwise(min(first_level + 1, 6))
    return h.withColumn("raw", F.when(F.col("heading").isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("heading"))).otherwise(F.col("raw"))).drop("heading")


def front_matter(lines_df: DataFrame) -> DataFrame:
    """Heading-keyed front matter as one wide row for each document; e-mail lines of authors are contacts."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    kind = F.last(F.when(T.strip(F.col("raw")).rlike(r"^#{1,6}\s"), F.coalesce(T.metadata_key(T.heading_text(F.col("raw"))), F.lit(""))), ignorenulls=True).over(w)
    held = lines_df.withColumn("key", kind).where("key <> ''").where(~T.strip(F.col("raw")).rlike(r"^#{1,6}\s")).withColumn("raw", T.strip(F.col("raw"))).where("raw <> ''")
    moved = held.withColumn("key", F.when((F.col("key") == "authors") & F.contains("raw", F.lit("@")) & (F.regexp_replace("raw", r"^\*+", "") != ""), "contacts").otherwise(F.col("key")))
    names = sorted(set(T.METADATA_KEYS.values()))
    ordered = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("key") == k, F.struct("line_no", "raw")))), lambda x: x["raw"])
    wide = moved.groupBy("doc_id").agg(*(ordered(k).alias(k) for k in names))
    return wide.select("doc_id", *(F.array_join(k, " ").alias(k) for k in names if k != "contacts"), "contacts", F.when(F.size("contacts") > 2, "contacts").alias("error"))
