"""Summaries: medians, weighted modes, class names, merged runs, column widths, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import cut

# Table headers under which equal neighbours are one group.
GROUPING = ["level", "group", "category", "class", "type", "family", "site", "site level", "factor", "block"]


def median_rows(runs: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Exact medians of the measures and the number of runs for each key; nulls have no place among the values.

    Values are counted first, with map-side combine, and a running count finds the middle, so that
    no key's values are held in one row.
    """
    out = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"))
    for m in measures:
        counts = runs.where(F.col(m).isNotNull()).groupBy(*keys, m).agg(F.count(F.lit(1)).alias("c"))
        w = Window.partitionBy(*keys)
        placed = counts.withColumn("upto", F.sum("c").over(w.orderBy(m).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
        first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
        at = lambda k: F.max(F.when((F.col("upto") >= k) & (F.col("upto") - F.col("c") < k), F.col(m)))
        middle = placed.groupBy(*keys).agg(((at(first) + at(second)) / 2).alias(m))
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        out = out.alias("a").join(middle.alias("b"), same, "left").select("a.*", f"b.{m}")
    return out.select(*keys, *measures, "runs")


def weighted_mode(rows: DataFrame, keys: list[str], value: str, weight: str, order: str) -> DataFrame:
    """For each key the value of most total weight; the earliest, then the smallest, wins a tie."""
    per = rows.groupBy(*keys, value).agg(F.sum(weight).alias("w"), F.min(order).alias("o"))
    return per.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("w"), "o", value)).alias(value), F.max("w").alias(weight))


def class_names(rows: DataFrame, style: str, signature: str, order: str) -> DataFrame:
    """style, signature, n, name: the commonest look of a style takes its name, later ones name-2, name-3."""
    per = rows.groupBy(style, signature).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    k = F.row_number().over(Window.partitionBy(style).orderBy(F.desc("n"), "o"))
    return per.select(style, signature, "n", F.when(k == 1, F.col(style)).otherwise(F.concat(F.col(style), F.lit("-"), k.cast("string"))).alias("name"))


def is_grouping(header: Column) -> Column:
    h = F.lower(F.trim(F.regexp_replace(header, "[^A-Za-z]+", " ")))
    return h.isin(GROUPING) | h.endswith(" level")


def merged_runs(cells: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, value, first, last of each run of equal neighbours longer than one; empty values do not merge."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)
    numbered = cells.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last")).where(F.col("last") > F.col("first")).where(F.col(value) != "").drop("run")


def column_widths(cells: DataFrame, keys: list[str], column: str, value: str, total: int, least: int = 240) -> DataFrame:
    """Width shares by longest text, rounded half to even, at least ``least``; the last column takes the rest."""
    longest = cells.groupBy(*keys, column).agg(F.greatest(F.max(F.length(value)), F.lit(1)).alias("len"))
    w = Window.partitionBy(*keys)
    share = F.greatest(F.bround(F.lit(float(total)) * F.col("len") / F.sum("len").over(w), 0).cast("long"), F.lit(least))
    sized = longest.withColumn("width", share).withColumn("last", F.max(column).over(w))
    others = F.sum(F.when(F.col(column) != F.col("last"), F.col("width")).otherwise(0)).over(w)
    return sized.select(*keys, column, F.when(F.col(column) == F.col("last"), F.greatest(F.lit(total) - others, F.lit(least))).otherwise(F.col("width")).alias("width"))


def flatten_header(cells: DataFrame) -> DataFrame:
    """doc_id, column, header: two header rows joined, each cell standing for the columns it spans.

    cells: (doc_id, row 0 or 1, column, colspan, text).
    """
    each = cells.select("doc_id", "row", F.explode(F.sequence("column", F.col("column") + F.col("colspan") - 1)).alias("column"), "text")
    wide = each.groupBy("doc_id", "column").agg(F.max(F.when(F.col("row") == 0, F.col("text"))).alias("top"), F.max(F.when(F.col("row") == 1, F.col("text"))).alias("low"))
    return wide.select("doc_id", "column", F.when((F.coalesce("low", F.lit("")) == "") | (F.col("low") == F.col("top")), F.col("top")).when(F.coalesce("top", F.lit("")) == "", F.col("low")).otherwise(F.concat_ws(" ", "top", "low")).alias("header"))


# -- provenance -----------------------------------------------------------------------
def artifacts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, size, sha256 of contents, one row a path."""
    return files.select(F.col(path).alias("path"), F.length(content).cast("long").alias("size"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256")).distinct()


def changed(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """path, code: recorded artifacts that are gone or whose size or hash differs."""
    r = now.select("path", F.col("size").alias("size2"), F.col("sha256").alias("sha2562"))
    code = F.when(F.col("sha2562").isNull(), "artifact.missing").when(F.col("size") != F.col("size2"), "artifact.size").when(F.col("sha256") != F.col("sha2562"), "artifact.sha256")
    return recorded.join(r, "path", "left").select("path", code.alias("code")).where("code is not null")


def checksum_line(sha: Column, path: Column) -> Column:
    return F.concat(sha, F.lit("  "), path)


def parse_checksum(line: Column) -> Column:
    """struct(sha256, path) of a checksum line, or null."""
    p = r"^([0-9a-f]{64})  (.+)$"
    return F.when(line.rlike(p), F.struct(F.regexp_extract(line, p, 1).alias("sha256"), F.regexp_extract(line, p, 2).alias("path")))


def tree_hash(rows: DataFrame, group: str, path: str, line: Column, buckets: int = 3) -> DataFrame:
    """group, n, hash over all lines of a group, in two levels: lines in path order by the first hex digits of the path's hash, then buckets in order.

    A bucket is a small part of a group (16 ** buckets of them), so no group's lines meet in one row.
    """
    held = rows.select(group, F.substring(F.sha2(F.col(path), 256), 1, buckets).alias("bucket"), F.struct(F.col(path).alias("path"), line.alias("line")).alias("x"))
    joined = lambda c, k: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x[k]), "\n"), 256)
    parts = held.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("n"), joined("x", "line").alias("part"))
    return parts.groupBy(group).agg(F.sum("n").alias("n"), joined(F.struct("bucket", "part"), "part").alias("hash"))


def manifest(arts: DataFrame, group: str) -> DataFrame:
    """group, n, bytes and a hash of all artifacts, which no run id enters. The artifacts themselves stay rows."""
    line = F.concat_ws(" ", F.col("sha256"), F.col("size"), F.col("path"))
    sizes = arts.groupBy(group).agg(F.sum("size").alias("bytes"))
    return tree_hash(arts, group, "path", line).join(sizes, group).select(group, "n", "bytes", F.col("hash").alias("semantic_hash"))


def stable_id(value: Column) -> Column:
    """Eight hex digits: the value itself if it is such, else the head of its SHA-1."""
    return F.when(value.rlike("^[0-9A-Fa-f]{8}$"), F.upper(value)).otherwise(F.upper(F.substring(F.sha1(value), 1, 8)))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.sha1(a), F.sha1(b))


def missing_artifacts(required: DataFrame, arts: DataFrame) -> DataFrame:
    """name: required ids or roles that no artifact has. Two equi anti joins, not one disjunction."""
    return required.join(arts.select(F.col("id").alias("name")), "name", "left_anti").join(arts.select(F.col("role").alias("name")), "name", "left_anti")


def select_inputs(stages: DataFrame, arts: DataFrame) -> DataFrame:
    """stage, key, id: the first artifact whose id, else whose role, is what a stage consumes.

    stages: (stage, key); arts: (id, role, ordinal).
    """
    by_id = stages.join(arts.select("id", "ordinal", F.col("id").alias("key")), "key").select("stage", "key", "id", "ordinal")
    by_role = stages.join(arts.select("id", "ordinal", F.col("role").alias("key")), "key").select("stage", "key", "id", "ordinal")
    return by_id.unionByName(by_role).groupBy("stage", "key").agg(F.min_by("id", "ordinal").alias("id"))


def source_pack(files: DataFrame, allowed: list[str]) -> DataFrame:
    """Path, Size_bytes, SHA256 of the files whose path matches an allowed glob, in path order."""
    import re
    from functools import reduce

    star = lambda g: "^" + re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    keep = reduce(lambda k, g: k | F.col("path").rlike(star(g)), allowed, F.lit(False))
    return artifacts(files.where(keep)).select(F.col("path").alias("Path"), F.col("size").alias("Size_bytes"), F.col("sha256").alias("SHA256")).orderBy("Path")


# -- properties and styles -----------------------------------------------------------------
def merge_properties(base: Column, override: Column) -> Column:
    """A property map under an override; ``-key`` takes out key and what is below it, then new values are set."""
    gone = F.transform(F.filter(F.map_keys(override), lambda k: k.startswith("-")), lambda k: F.substr(k, F.lit(2)))
    sets = F.map_filter(override, lambda k, _: ~k.startswith("-"))
    covered = lambda k: F.exists(gone, lambda g: (k == g) | k.startswith(F.concat(g, F.lit("@"))) | k.startswith(F.concat(g, F.lit("/"))))
    kept = F.map_filter(base, lambda k, _: ~covered(k) & ~F.map_contains_key(sets, k))
    return F.map_concat(kept, sets)


def diff_properties(base: Column, target: Column) -> Column:
    """The least override that turns base into target."""
    sets = F.map_filter(target, lambda k, v: ~F.coalesce(base[k] == v, F.lit(False)))
    gone = F.map_filter(base, lambda k, _: ~F.map_contains_key(target, k))
    return F.map_concat(F.transform_keys(gone, lambda k, _: F.concat(F.lit("-"), k)), sets)


def clean_properties(props: Column) -> Column:
    """Without the ids that editors renew on every save."""
    return F.map_filter(props, lambda k, _: ~k.rlike(r"(?i)(?:^|[@/:])(?:rsid\w*|paraId|textId|id)$"))


def format_properties(props: Column) -> Column:
    """``key=value`` words in key order; keys without a value stand alone."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(props)), lambda e: F.when(F.coalesce(e["value"], F.lit("")) == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), F.when(e["value"].rlike(r"[\s\"]"), F.concat(F.lit('"'), F.replace(e["value"], F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(e["value"])))), " ")


def parse_properties(text: Column) -> Column:
    """The map of a line of ``key=value`` words."""
    words = T.split_words(text)
    value = lambda w: F.replace(F.regexp_replace(F.regexp_replace(w, "^[^=]*=?", ""), r'^"|"$', ""), F.lit('\\"'), F.lit('"'))
    return F.map_from_entries(F.transform(words, lambda w: F.struct(F.regexp_extract(w, "^([^=]*)", 1).alias("key"), value(w).alias("value"))))


def inherited(styles: DataFrame) -> DataFrame:
    """style, depth, ancestor along ``styles(style, based_on)``, however long a chain is; a loop ends where it began.

    Each round doubles the distance that is known, so a chain of n styles takes log2(n) joins.
    """
    nearest = lambda d: d.groupBy("style", "ancestor").agg(F.min("depth").alias("depth"))
    own = styles.select("style", F.col("style").alias("ancestor"), F.lit(0).alias("depth"))
    known = cut(nearest(own.unionByName(styles.where("based_on is not null").select("style", F.col("based_on").alias("ancestor"), F.lit(1).alias("depth")))))
    n = known.count()
    while True:
        onward = known.select(F.col("style").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        known = cut(nearest(known.join(onward, "ancestor").select("style", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))))
        before, n = n, known.count()
        if n == before:
            return known.select("style", "depth", "ancestor")


def resolved_styles(styles: DataFrame, properties: DataFrame) -> DataFrame:
    """style, property, value: the nearest definition along the chain wins. properties: (style, property, value)."""
    chain = inherited(styles).select("style", "depth", "ancestor")
    held = properties.select(F.col("style").alias("ancestor"), "property", "value")
    return chain.join(held, "ancestor").groupBy("style", "property").agg(F.min_by("value", "depth").alias("value"))
