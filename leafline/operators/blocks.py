"""Relational work on block rows: captions, notes, figures, numbering, semantic hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _doc(*order: str):
    return Window.partitionBy("doc_id").orderBy(*(order or ("ordinal",)))


def table_notes(blocks: DataFrame) -> DataFrame:
    """Blocks with table_id and orphan: a table opens a window, notes keep it open, anything else closes it."""
    w = _doc()
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    kind, orphan = F.col("kind"), F.coalesce(F.col("options")["orphan"], F.lit("false")) == "true"
    n = F.sum((kind == "table").cast("int")).over(past)
    # A window's rows are those since the last block that is neither a note nor inherits one; an orphan closes it too.
    breaks = F.max(F.when(~kind.isin("table", "table_foot") | ((kind == "table_foot") & orphan), F.col("ordinal"))).over(past)
    opened = F.max(F.when(kind == "table", F.col("ordinal"))).over(past)
    live = opened.isNotNull() & (breaks.isNull() | (breaks < opened))
    label = F.coalesce(F.nullif(F.col("options")["label"], F.lit("")), T.note_label(F.col("text"))["label"])
    marked = blocks.withColumn("live", live).withColumn("n", n)
    return marked.select(
        *blocks.columns, F.when((F.col("kind") == "table") | ((F.col("kind") == "table_foot") & F.col("live")), F.col("n")).alias("table_id"),
        F.when(F.col("kind") == "table_foot", ~F.col("live")).alias("orphan_note"), F.when(F.col("kind") == "table_foot", label).alias("note_label"),
    )


def note_findings(noted: DataFrame) -> DataFrame:
    """doc_id, code, table_id, label: orphan notes, labels twice in a table, cell markers without a note."""
    orphan = noted.where("orphan_note or options['table_note_orphan'] = 'true'").select("doc_id", F.lit("table_note.orphan").alias("code"), F.lit(None).cast("long").alias("table_id"), F.coalesce("note_label", F.col("options")["label"]).alias("label"))
    notes = noted.where("kind = 'table_foot' and not orphan_note and note_label <> ''").select("doc_id", F.col("table_id").cast("long").alias("table_id"), F.col("note_label").alias("label"))
    twice = notes.groupBy("doc_id", "table_id", "label").count().where("count > 1").select("doc_id", F.lit("table_note.duplicate_label").alias("code"), "table_id", "label")
    cells = noted.where("kind = 'table'").select("doc_id", F.col("table_id").cast("long").alias("table_id"), F.explode(T.cell_note_labels(F.flatten("cells"))).alias("label"))
    with_notes = notes.select("doc_id", "table_id").distinct()
    bare = cells.join(with_notes, ["doc_id", "table_id"], "left_semi").join(notes, ["doc_id", "table_id", "label"], "left_anti").select("doc_id", F.lit("table_note.missing_label").alias("code"), "table_id", "label")
    return orphan.unionByName(twice).unionByName(bare)


def reserved_labels(blocks: DataFrame) -> DataFrame:
    """doc_id, label, duplicate of authored table labels, compared without case and spacing."""
    held = blocks.where("kind = 'table_caption' and coalesce(options['caption_label'], '') <> ''").select("doc_id", F.lower(T.squeeze(F.col("options")["caption_label"])).alias("label"))
    return held.groupBy("doc_id", "label").agg((F.count(F.lit(1)) > 1).alias("duplicate"))


def numbered_captions(blocks: DataFrame, kind: str = "image", word: str = "Figure", prefix: str = "", start: int = 1) -> DataFrame:
    """doc_id, ordinal, number, caption: captions of one kind numbered in order."""
    n = F.row_number().over(_doc()) + (start - 1)
    some = blocks.where(F.col("kind") == kind)
    return some.select("doc_id", "ordinal", n.alias("number"), F.concat(F.lit(f"{word} {prefix}"), n.cast("string"), F.lit(". "), T.strip(F.coalesce("text", F.lit("")))).alias("caption"))


def image_captions(blocks: DataFrame) -> DataFrame:
    """doc_id, ordinal, caption, consumed: the next caption paragraph, else a telling alt text."""
    following = F.lead(F.struct("kind", "text")).over(_doc())
    some = blocks.withColumn("next", following).where("kind = 'image'")
    takes = F.coalesce(F.col("next.kind").isin("paragraph", "toc_text") & T.is_caption(F.col("next.text")), F.lit(False))
    alt = T.strip(F.coalesce("text", F.lit("")))
    return some.select("doc_id", "ordinal", F.when(takes, T.strip(F.col("next.text"))).when((alt != "") & ~T.is_filename_alt(alt), alt).otherwise("").alias("caption"), takes.alias("consumed"))


def figure_groups(blocks: DataFrame) -> DataFrame:
    """Blocks with group: the text before an image, the image, and a caption right behind it share one."""
    w = _doc()
    before = F.coalesce(F.sum((F.col("kind") == "image").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    caption = (F.lag("kind").over(w) == "image") & (F.col("kind") == "paragraph") & T.is_caption(F.col("text"))
    return blocks.withColumn("group", before - F.coalesce(caption, F.lit(False)).cast("int"))


def abstract(blocks: DataFrame) -> DataFrame:
    """Blocks with in_abstract: between the first H1 named abstract and the next H1, keywords left out."""
    w, doc = _doc().rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("doc_id")
    h1 = (F.col("kind") == "heading") & (F.col("level") == 1)
    named = h1 & (F.lower(T.strip(F.coalesce("text", F.lit("")))) == "abstract")
    # Counting H1 headings makes each its own part; the abstract is the part that the first named one begins.
    parts = blocks.withColumn("part", F.sum(h1.cast("int")).over(w)).withColumn("begin", F.min(F.when(named, F.col("ordinal"))).over(doc))
    parts = parts.withColumn("wanted", F.max(F.when(F.col("ordinal") == F.col("begin"), F.col("part"))).over(doc))
    inside = (F.col("part") == F.col("wanted")) & (F.col("ordinal") != F.col("begin")) & (F.col("kind") != "keywords")
    return parts.withColumn("in_abstract", F.coalesce(inside, F.lit(False))).drop("part", "begin", "wanted")


def list_runs(blocks: DataFrame) -> DataFrame:
    """Blocks with list_id: consecutive items of one kind are one list."""
    w = _doc()
    item = F.col("kind").isin("ordered", "bullet")
    fresh = item & (F.coalesce(F.lag("kind").over(w), F.lit("")) != F.col("kind"))
    return blocks.withColumn("list_id", F.when(item, F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def with_options(options: Column, updates: dict[str, str]) -> Column:
    """A map with keys set, or taken out where the new value is empty."""
    kept = F.map_filter(options, lambda k, _: ~k.isin(list(updates)))
    new = {k: v for k, v in updates.items() if v != ""}
    return F.map_concat(kept, F.create_map(*[F.lit(x) for kv in new.items() for x in kv])) if new else kept


def resolved_option(table: Column, caption: Column, key: str, default: str) -> Column:
    """struct(value, conflict) of a layout option from the table, its caption, or the default."""
    t, c = F.nullif(table[key], F.lit("")), F.nullif(caption[key], F.lit(""))
    return F.struct(F.coalesce(t, c, F.lit(default)).alias("value"), F.coalesce(t != c, F.lit(False)).alias("conflict"))


# -- identity ------------------------------------------------------------------------
def canonical_map(options: Column) -> Column:
    """A map as text with its keys in order, for hashes and comparisons."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(options))))


def semantic_hash(blocks: DataFrame) -> DataFrame:
    """doc_id, n_blocks, semantic_hash: what a document says, without ids, paths or positions in a file."""
    row = F.struct("ordinal", F.sha2(F.concat_ws("\u001f", "kind", F.coalesce("text", F.lit("")), F.col("level").cast("string"), F.coalesce(F.to_json("cells"), F.lit("")), F.coalesce("language", F.lit("")), F.coalesce(canonical_map(F.col("options")), F.lit(""))), 256).alias("h"))
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["h"]), "\n"), 256).alias("semantic_hash"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, status of two versions: same, changed, added or removed."""
    a, b = semantic_hash(before).select("doc_id", F.col("semantic_hash").alias("a")), semantic_hash(after).select("doc_id", F.col("semantic_hash").alias("b"))
    return a.join(b, "doc_id", "full").select("doc_id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("status"))


def validate(nodes: DataFrame, resources: DataFrame) -> DataFrame:
    """doc_id, code, node_id: duplicate ids, figures without a resource, bad spans, empty reference keys.

    nodes: (doc_id, node_id, kind, target, key, start, stop); resources: (doc_id, resource_id).
    """
    twice = nodes.groupBy("doc_id", "node_id").count().where("count > 1").select("doc_id", F.lit("node.duplicate_id").alias("code"), "node_id")
    figures = nodes.where("kind = 'figure'").join(resources.select("doc_id", F.col("resource_id").alias("target")), ["doc_id", "target"], "left_anti").select("doc_id", F.lit("figure.resource_missing").alias("code"), "node_id")
    spans = nodes.where("start < 0 or stop < start").select("doc_id", F.lit("node.bad_span").alias("code"), "node_id")
    keys = nodes.where("kind = 'reference' and trim(coalesce(key, '')) = ''").select("doc_id", F.lit("reference.empty_key").alias("code"), "node_id")
    copies = resources.groupBy("doc_id", "resource_id").count().where("count > 1").select("doc_id", F.lit("resource.duplicate_id").alias("code"), F.col("resource_id").alias("node_id"))
    return twice.unionByName(figures).unionByName(spans).unionByName(keys).unionByName(copies)


def export_losses(blocks: DataFrame, capabilities: DataFrame) -> DataFrame:
    """doc_id, ordinal, kind of blocks that a writer's ``capabilities(kind)`` lack."""
    return blocks.join(capabilities.select("kind"), "kind", "left_anti").select("doc_id", "ordinal", "kind")


def plan_media(resources: DataFrame) -> DataFrame:
    """doc_id, ordinal, path, target: portable paths, later ones of a name suffixed -2, -3."""
    rel = T.portable_path(F.col("path"))
    k = F.row_number().over(Window.partitionBy("doc_id", F.lower(F.coalesce("rel", F.lit("")))).orderBy("ordinal"))
    stem, ext = F.regexp_replace("rel", r"(\.[^./]*)$", ""), F.regexp_extract("rel", r"(\.[^./]*)$", 1)
    return resources.withColumn("rel", F.coalesce(rel, F.regexp_extract("path", r"([^/\\]+)$", 1))).select("doc_id", "ordinal", "path", F.when(k == 1, F.col("rel")).otherwise(F.concat(stem, F.lit("-"), k.cast("string"), ext)).alias("target"))


def render_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown: blocks as Markdown again, one expression a block and one ordered list a document."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, T.escape_pipes), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("alignments", lambda a: F.when(a == "center", ":---:").when(a == "left", ":---").when(a == "right", "---:").otherwise("---")), " | "), F.lit(" |"))
    table = F.array_join(F.concat(F.array(row(F.col("cells")[0]), rule), F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), row)), "\n")
    t, k = F.coalesce("text", F.lit("")), F.col("kind")
    pad = F.repeat(F.lit("  "), F.col("level"))
    md = (
        F.when(k == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), t)).when(k == "ordered", F.concat(pad, t)).when(k == "bullet", F.concat(pad, F.lit("- "), t)).when(k == "quote", F.concat(F.lit("> "), t))
        .when(k == "code", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), t, F.lit("\n```"))).when(k == "algorithm", F.concat(F.lit("```"), F.coalesce("language", F.lit("algorithm")), F.lit("\n"), t, F.lit("\n```")))
        .when(k == "equation", F.concat(F.lit("$$\n"), t, F.lit("\n$$"))).when(k == "separator", F.lit("---")).when(k == "image", F.concat(F.lit("!["), t, F.lit("]("), F.col("path"), F.lit(")"))).when(k == "table", table)
        .when((k == "table_caption") & F.col("options")["caption_label"].isNotNull(), F.concat(F.col("options")["caption_label"], F.coalesce(F.col("options")["caption_punctuation"], F.lit(".")), F.coalesce(F.nullif(F.col("options")["caption_gap"], F.lit("")), F.lit(" ")), t))
        .when(k == "table_caption", F.concat(F.lit("Table: "), t)).when((k == "table_foot") & (F.col("options")["source"] == "directive"), F.concat(F.lit("Table note: "), t)).otherwise(t)
    )
    rows = blocks.where("kind <> 'error'").withColumn("md", md)
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "md"))), lambda x: x["md"]), "\n\n").alias("markdown"))


def render_latex(blocks: DataFrame) -> DataFrame:
    """doc_id, latex: blocks as TeX."""
    t, k = F.coalesce("text", F.lit("")), F.col("kind")
    e = T.escape_tex(t)
    env = lambda n, body: F.concat(F.lit(f"\\begin{{{n}}}\n"), body, F.lit(f"\n\\end{{{n}}}"))
    head = F.element_at(F.array(*map(F.lit, ["section", "subsection", "subsubsection", "paragraph", "subparagraph", "subparagraph"])), F.greatest(F.col("level"), F.lit(1)))
    cells = F.array_join(F.transform("cells", lambda r: F.concat(F.array_join(F.transform(r, T.escape_tex), " & "), F.lit(r" \\"))), "\n")
    tex = (
        F.when(k == "heading", F.concat(F.lit("\\"), head, F.lit("{"), e, F.lit("}"))).when(k == "ordered", env("enumerate", F.concat(F.lit("\\item "), T.escape_tex(F.regexp_replace(t, r"^\d+\.\s+", ""))))).when(k == "bullet", env("itemize", F.concat(F.lit("\\item "), e)))
        .when(k == "quote", env("quote", e)).when(k.isin("code", "algorithm"), env("verbatim", t)).when(k == "equation", F.concat(F.lit("\\[\n"), T.display_math(t), F.lit("\n\\]"))).when(k == "separator", F.lit("\\medskip\\hrule\\medskip"))
        .when(k == "image", env("figure", F.concat(F.lit("\\includegraphics{"), F.col("path"), F.lit("}\n\\caption{"), e, F.lit("}")))).when(k == "table", F.concat(F.lit("\\begin{tabular}{"), F.repeat(F.lit("l"), F.greatest(F.size(F.col("cells")[0]), F.lit(1))), F.lit("}\n"), cells, F.lit("\n\\end{tabular}"))).otherwise(e)
    )
    rows = blocks.where("kind <> 'error'").withColumn("tex", tex)
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "tex"))), lambda x: x["tex"]), "\n\n").alias("latex"))
