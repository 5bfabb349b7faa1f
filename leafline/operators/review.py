"""Comparing documents and packages, styles across documents, and what else follows from blocks by joins."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import cut
from .align import ratio, word_edits
from .delta import map_blocks


#: How alike two rows are at least that are one, rewritten.
ROW_RATIO = 0.5


# -- shapes and tables ------------------------------------------------------------------
def same_shape(base: DataFrame, current: DataFrame) -> DataFrame:
    """doc_id, same: whether both versions have the same slots: kind, style and drawing by ordinal."""
    slot = lambda d: d.select("doc_id", "ordinal", F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in d.columns else F.lit("") for c in ("kind", "style", "drawing"))).alias("slot"))
    both = slot(base).withColumnRenamed("slot", "a").join(slot(current).withColumnRenamed("slot", "b"), ["doc_id", "ordinal"], "full")
    return both.groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("same"))


def table_redline(base: DataFrame, current: DataFrame) -> DataFrame:
    """doc_id, table_id, step, action (same, changed, insert, delete), base_row, current_row, cells of (doc_id, table_id, row, cells).

    Equal rows are matched first. Between them, rows of as many cells are one row, in order, where
    their texts are alike by half at least, so that the likenesses add up to the most; their cells
    hold word edits. Other rows went or came whole.
    """

    def edits(old, new):
        return [[{"op": o, "text": t} for o, t in word_edits(x, y)] for x, y in zip(old, new)]

    def rewritten(old, new):
        """Order-preserving pairs of rows."""
        texts = [[" | ".join(r["cells"] or []) for r in side] for side in (old, new)]
        best = [[0.0] * (len(new) + 1) for _ in range(len(old) + 1)]
        like = [[0.0] * len(new) for _ in old]
        for i in range(len(old) - 1, -1, -1):
            for j in range(len(new) - 1, -1, -1):
                if len(old[i]["cells"] or []) == len(new[j]["cells"] or []):
                    r = ratio(texts[0][i], texts[1][j])
                    like[i][j] = r if r >= ROW_RATIO else 0.0
                best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + like[i][j])
        out, i, j = [], 0, 0
        while i < len(old) and j < len(new):
            if like[i][j] and best[i][j] == best[i + 1][j + 1] + like[i][j]:
                out.append((old[i], new[j]))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
        return out

    def run(left, right):
        import pyarrow as pa

        a, b = (sorted(t.to_pylist(), key=lambda r: r["slot"]["row"]) for t in (left, right))
        key = (a or b)[0]
        a, b = [r["slot"] for r in a], [r["slot"] for r in b]
        rows = []
        for op, i, j, k, l in SequenceMatcher(None, [tuple(r["cells"] or []) for r in a], [tuple(r["cells"] or []) for r in b], autojunk=False).get_opcodes():
            pairs = list(zip(a[i:j], b[k:l])) if op == "equal" else rewritten(a[i:j], b[k:l])
            gone, come = {x["row"] for x, _ in pairs}, {y["row"] for _, y in pairs}
            rows += [("delete", x["row"], None, edits(x["cells"] or [], [""] * len(x["cells"] or []))) for x in a[i:j] if x["row"] not in gone]
            rows += [("same" if op == "equal" else "changed", x["row"], y["row"], edits(x["cells"] or [], y["cells"] or [])) for x, y in pairs]
            rows += [("insert", None, y["row"], edits([""] * len(y["cells"] or []), y["cells"] or [])) for y in b[k:l] if y["row"] not in come]
        cells = pa.list_(pa.list_(pa.struct([("op", pa.string()), ("text", pa.string())])))
        cols = list(zip(*rows)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), cells)
        return pa.table([pa.array([key["doc_id"]] * len(rows), pa.int64()), pa.array([key["table_id"]] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "table_id", "step", "action", "base_row", "current_row", "cells"])

    slot = lambda d: d.select(F.col("doc_id").cast("long"), F.col("table_id").cast("long"), F.struct(F.col("row").cast("long").alias("row"), F.col("cells").alias("cells")).alias("slot")).groupBy("doc_id", "table_id")
    schema = "doc_id long, table_id long, step int, action string, base_row long, current_row long, cells array<array<struct<op:string,text:string>>>"
    return slot(base).cogroup(slot(current)).applyInArrow(run, schema)


def comment_counts(marks: DataFrame) -> DataFrame:
    """doc_id, comment_id, starts, ends, references, whole of (doc_id, comment_id, mark): each comment needs one of each."""
    n = lambda k: F.count_if(F.col("mark") == k)
    per = marks.groupBy("doc_id", "comment_id").agg(n("start").alias("starts"), n("end").alias("ends"), n("reference").alias("references"))
    return per.withColumn("whole", (F.col("starts") == 1) & (F.col("ends") == 1) & (F.col("references") == 1))


VOLATILE = r"""\s(?:\w+:)?(?:rsid\w*|paraId|textId|id)=(?:"[^"]*"|'[^']*')"""


def element_signature(xml: Column) -> Column:
    """Hash of an element without the ids that editors renew on every save."""
    return F.sha2(F.regexp_replace(F.regexp_replace(xml, VOLATILE, ""), r">\s+<", "><"), 256)


def package_diff(original: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """doc_id, step, op (replace, delete, insert), first, last, other_first, other_last of runs of blocks whose signatures differ.

    Both: (doc_id, ordinal, signature). Positions count from 0; last is past the end.
    """

    def run(left, right):
        import pyarrow as pa

        a, b = (sorted(t.to_pylist(), key=lambda r: r["slot"]["ordinal"]) for t in (left, right))
        doc = (a or b)[0]["doc_id"]
        found = [x for x in SequenceMatcher(None, [r["slot"]["signature"] for r in a], [r["slot"]["signature"] for r in b], autojunk=False).get_opcodes() if x[0] != "equal"]
        cols = list(zip(*found)) or [[]] * 5
        return pa.table([pa.array([doc] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "step", "op", "first", "last", "other_first", "other_last"])

    slot = lambda d: d.select(F.col("doc_id").cast("long"), F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.col("signature").alias("signature")).alias("slot")).groupBy("doc_id")
    return slot(original).cogroup(slot(rebuilt)).applyInArrow(run, "doc_id long, step int, op string, first long, last long, other_first long, other_last long")


def exact_reuse(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """path, status of outputs that were to be the sources themselves: reused, changed or missing. Both: (path, sha256)."""
    both = sources.select("path", F.col("sha256").alias("a")).join(outputs.select("path", F.col("sha256").alias("b")), "path", "left")
    return both.select("path", F.when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "reused").otherwise("changed").alias("status"))


def map_blocks_with(source: DataFrame, target: DataFrame, authored: DataFrame) -> DataFrame:
    """doc_id, source_ordinal, target_ordinal, how (map, match, opaque, stale) of (doc_id, ordinal, key, opaque) blocks.

    authored: (doc_id, source_ordinal, target_ordinal, key), a map made when the source block had
    that key. An entry whose source block has another key by now is stale and refused; the others
    hold. The rest is matched by keys; opaque blocks pair by their order.
    """
    blocks = lambda d, side: d.select("doc_id", F.col("ordinal").cast("long").alias(f"{side}_ordinal"), F.col("key").alias(f"{side}_key"), F.coalesce("opaque", F.lit(False)).alias(f"{side}_opaque"))
    a, b = blocks(source, "source"), blocks(target, "target")
    named = authored.select("doc_id", F.col("source_ordinal").cast("long"), F.col("target_ordinal").cast("long"), "key").join(a, ["doc_id", "source_ordinal"], "left").join(b.select("doc_id", "target_ordinal", F.lit(True).alias("there")), ["doc_id", "target_ordinal"], "left")
    fixed = named.select("doc_id", "source_ordinal", "target_ordinal", F.when((F.col("key") == F.col("source_key")) & F.col("there"), "map").otherwise("stale").alias("how"))
    held = fixed.where("how = 'map'")
    rest_a, rest_b = a.join(held, ["doc_id", "source_ordinal"], "left_anti"), b.join(held, ["doc_id", "target_ordinal"], "left_anti")
    key = lambda d, side: d.where(~F.col(f"{side}_opaque")).select("doc_id", F.col(f"{side}_ordinal").alias("ordinal"), F.col(f"{side}_key").alias("key"))
    found = map_blocks(key(rest_a, "source"), key(rest_b, "target")).withColumn("how", F.lit("match"))
    nth = lambda d, side: d.where(F.col(f"{side}_opaque")).select("doc_id", f"{side}_ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy(f"{side}_ordinal")).alias("nth"))
    opaque = nth(rest_a, "source").join(nth(rest_b, "target"), ["doc_id", "nth"]).select("doc_id", "source_ordinal", "target_ordinal", F.lit("opaque").alias("how"))
    return fixed.unionByName(found).unionByName(opaque)


# -- styles across documents -----------------------------------------------------------------
def style_crosswalk(base: DataFrame, current: DataFrame) -> DataFrame:
    """current_id, base_id of styles(style_id, kind, name) that are one style by kind and name, whatever their ids; a name that stands twice on a side tells nothing."""
    name = F.lower(T.squeeze(F.col("name")))
    side = lambda d, as_: d.select(F.col("style_id").alias(as_), "kind", name.alias("name")).withColumn("twice", F.count(F.lit(1)).over(Window.partitionBy("kind", "name"))).where("twice = 1").drop("twice")
    return side(base, "base_id").join(side(current, "current_id"), ["kind", "name"]).select("current_id", "base_id")


def template_closure(styles: DataFrame, wanted: DataFrame, has: Column | None = None) -> DataFrame:
    """style, missing: all styles that wanted(style) need along ``based_on`` and ``link`` of styles(style, based_on, link); missing where the template has none.

    has: whether the template has a ``style``, where links are stated for more or fewer styles than it holds; else it has those of styles.
    """
    edges = cut(styles.select("style", F.explode(F.array_compact(F.array("based_on", "link"))).alias("to")).distinct())
    reached = step = cut(wanted.select("style").distinct())
    while step.limit(1).count():
        found = step.join(edges, "style").select(F.col("to").alias("style")).distinct()
        step = cut(found.join(reached, "style", "left_anti"))
        reached = cut(reached.union(step))
    if has is not None:
        return reached.select("style", (~has).alias("missing"))
    known = styles.select("style").distinct().withColumn("known", F.lit(True))
    return reached.join(known, "style", "left").select("style", F.col("known").isNull().alias("missing"))


def direct_run(runs: DataFrame) -> DataFrame:
    """doc_id, paragraph, bold, italic, underline, font, size, color of (doc_id, paragraph, ordinal, ...) runs: any emphasis, and the first value of the others."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c)
    return runs.groupBy("doc_id", "paragraph").agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in ("bold", "italic", "underline")), *(first(c) for c in ("font", "size", "color")))


def visible_looks(runs: DataFrame, properties: DataFrame, table_properties: DataFrame | None = None) -> DataFrame:
    """doc_id, ordinal, look (a map): what a run shows, from its own properties, its style's and its table's, the nearest first.

    runs: (doc_id, ordinal, style, own map, table_style); properties: resolved (style, property, value).
    """
    maps = lambda d, key, name: d.groupBy(F.col("style").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias(name))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    wide = runs.join(maps(properties, "style", "by_style"), "style", "left")
    wide = wide.join(maps(table_properties, "table_style", "by_table"), "table_style", "left") if table_properties is not None else wide.withColumn("by_table", none)
    over = lambda low, high: F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)
    own, style, table = (F.coalesce(c, none) for c in ("own", "by_style", "by_table"))
    return wide.select("doc_id", "ordinal", over(over(table, style), own).alias("look"))


# -- nodes, headings, captions --------------------------------------------------------------
def walk(nodes: DataFrame) -> DataFrame:
    """doc_id, position, node_id in reading order of nodes(doc_id, ordinal, ...): children follow their parent."""
    return nodes.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")) - 1)


def plain_subtrees(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, plain: the text below each node, from nodes(doc_id, node_id, ordinal, last, text), where last is the ordinal of a node's last descendant."""
    below = nodes.select("doc_id", F.col("ordinal").alias("at"), F.col("text").alias("part"))
    joined = nodes.select("doc_id", "node_id", "ordinal", "last").join(below, "doc_id").where("at between ordinal and last")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("part", F.lit("")).alias("part")))), lambda x: x["part"])
    return joined.groupBy("doc_id", "node_id").agg(F.array_join(parts, "").alias("plain"))


def heading_findings(blocks: DataFrame) -> DataFrame:
    """doc_id, ordinal, code of headings that a reader's outline lacks: no level from 1 to 6, or no text."""
    h = blocks.where("kind = 'heading'")
    code = F.when(~F.coalesce(F.col("level").between(1, 6), F.lit(False)), "heading.outline_level").when(T.strip(F.coalesce("text", F.lit(""))) == "", "heading.empty")
    return h.select("doc_id", "ordinal", code.alias("code")).where("code is not null")


def ambiguous_directives(lines: DataFrame) -> DataFrame:
    """doc_id, line_no of ``Table: Table 5. ...`` lines, which name a caption in both ways."""
    return lines.where(T.strip(F.col("raw")).rlike(r"(?i)^table\s*:\s*table\s+[A-Za-z]*\d+\s*[.:]")).select("doc_id", "line_no", F.lit("table.ambiguous_caption").alias("code"))


def page_spans(blocks: DataFrame) -> DataFrame:
    """doc_id, first, last: a table with the caption before it and the notes behind it is one group that stays together."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    kind = F.col("kind")
    opens = (kind == "table_caption") | (kind == "table") & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "table_caption")
    part = F.sum(F.when(opens | ~kind.isin("table", "table_foot", "table_caption"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    groups = blocks.withColumn("part", part).where(kind.isin("table", "table_foot", "table_caption")).groupBy("doc_id", "part")
    return groups.agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.bool_or(kind == "table").alias("held")).where("held").select("doc_id", "first", "last")


# -- citations -------------------------------------------------------------------------------
def superscript_keys(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Texts with keys: the citation keys of a superscript's numbers, or null unless each number is known. texts: (doc_id, ordinal, numbers); known: (doc_id, number, key)."""
    each = texts.select("doc_id", "ordinal", F.posexplode("numbers").alias("place", "number"))
    named = each.join(known.select("doc_id", "number", "key"), ["doc_id", "number"], "left").groupBy("doc_id", "ordinal")
    keys = named.agg(F.bool_and(F.col("key").isNotNull()).alias("all"), F.transform(F.sort_array(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("keys"))
    return texts.join(keys.select("doc_id", "ordinal", F.when(F.col("all"), F.col("keys")).alias("keys")), ["doc_id", "ordinal"], "left")


def trailing_citations(plan: DataFrame, trailing: DataFrame) -> DataFrame:
    """doc_id, key, number: keys that are cited only behind the bibliography go on where its numbers end, in order of first citation.

    plan: (doc_id, key, number); trailing: (doc_id, position, key).
    """
    first = trailing.groupBy("doc_id", "key").agg(F.min("position").alias("position")).join(plan.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    last = plan.groupBy("doc_id").agg(F.max("number").alias("last"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("position"))
    more = first.join(last, "doc_id", "left").select("doc_id", "key", (F.coalesce("last", F.lit(0)) + n).cast("int").alias("number"))
    return plan.select("doc_id", "key", F.col("number").cast("int").alias("number")).unionByName(more)


# -- review ------------------------------------------------------------------------------------
ENVIRONMENTS = r"(?s)\\begin\{(?:table|figure|equation|align|tabular|verbatim|lstlisting)\*?\}.*?\\end\{(?:table|figure|equation|align|tabular|verbatim|lstlisting)\*?\}"


def source_spans(sources: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, ordinal, first, last (code points, end exclusive) of each text(doc_id, ordinal, text) in sources(doc_id, text), null where it stands nowhere, twice, or inside an environment."""
    blanked = F.regexp_replace(F.col("source"), ENVIRONMENTS, "")
    both = texts.join(sources.select("doc_id", F.col("text").alias("source")), "doc_id")
    at = F.expr("locate(text, source)")
    again = F.expr("locate(text, source, locate(text, source) + 1)")
    outside = F.contains(blanked, F.col("text"))
    one = (F.length("text") > 0) & (at > 0) & (again == 0) & outside
    return both.select("doc_id", "ordinal", F.when(one, at - 1).alias("first"), F.when(one, at - 1 + F.length("text")).alias("last"))


def review_bundle(baseline: DataFrame, reviewed: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, ordinal, before, after, first, last, status of the paragraphs that a review changed.

    baseline, reviewed: (doc_id, ordinal, text). Status: ready, unplaced (no span of its own in the
    source), overlap (its span meets the next one's) or unpaired (the review has more or fewer paragraphs).
    """
    pairs = baseline.select("doc_id", "ordinal", F.col("text").alias("before")).join(reviewed.select("doc_id", "ordinal", F.col("text").alias("after")), ["doc_id", "ordinal"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
    spans = source_spans(sources, pairs.where("before is not null").select("doc_id", "ordinal", F.col("before").alias("text")))
    placed = pairs.join(spans, ["doc_id", "ordinal"], "left")
    w = Window.partitionBy("doc_id").orderBy(F.col("first").asc_nulls_last(), "ordinal")
    meets = (F.lead("first").over(w) < F.col("last")) | (F.lag("last").over(w) > F.col("first"))
    status = F.when(F.col("before").isNull() | F.col("after").isNull(), "unpaired").when(F.col("first").isNull(), "unplaced").when(F.coalesce(meets, F.lit(False)), "overlap").otherwise("ready")
    return placed.withColumn("status", status)
