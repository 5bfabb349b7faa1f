"""Citations: scanning, validation, numbering, labels of clusters, label indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CITE = r"\\citep?\{([^{}]+)\}"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, position, key: every cited key, in reading order."""
    groups = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(CITE), F.lit(1)), lambda g: F.filter(F.transform(F.split(g, ","), lambda k: F.trim(k)), lambda k: k != "")))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(groups).alias("position", "key"))


def unknown_keys(cited: DataFrame, bib: DataFrame) -> DataFrame:
    """doc_id, key: cited keys that the bibliography lacks."""
    return cited.select("doc_id", "key").distinct().join(bib.select("key"), "key", "left_anti").select("doc_id", "key")


def plan(cited: DataFrame, *, inherited: DataFrame | None = None, bib: DataFrame | None = None, prefix: str = "", supplement: str = "S", numbering: str = "first-citation") -> DataFrame:
    """doc_id, ordinal, key, label, inherited: a number for each key of each document.

    cited: (doc_id, position, key). Keys of ``inherited(key, number)`` keep their number and come
    first; others count from 1 in order of first citation, or of ``bib(key, ordinal)`` under
    source-order, and take a prefix as soon as there is one or an inherited map.
    """
    first = cited.groupBy("doc_id", "key").agg(F.min("position").alias("position"))
    first = first.join(inherited.select("key", "number"), "key", "left") if inherited is not None else first.withColumn("number", F.lit(None).cast("long"))
    has = F.col("number").isNotNull()
    order = "position"
    if numbering == "source-order":
        first = first.join(bib.select("key", F.col("ordinal").alias("source")), "key", "left")
        order = "source"
    local = F.row_number().over(Window.partitionBy("doc_id", has).orderBy(order, "key"))
    lead = F.lit(prefix or supplement) if prefix or inherited is not None else F.lit("")
    label = F.when(has, F.col("number").cast("string")).otherwise(F.concat(lead, local.cast("string")))
    shared = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(has, 0).otherwise(1), F.when(has, F.col("position")).otherwise(F.col(order)), "key"))
    return first.select("doc_id", shared.alias("ordinal"), "key", label.alias("label"), has.alias("inherited"))


def cluster_labels(clusters: DataFrame, numbers: DataFrame, shown) -> DataFrame:
    """doc_id, cluster, label: clusters(doc_id, cluster, position, key) shown by a dialect of ranges."""
    held = clusters.join(numbers.select("doc_id", "key", "label"), ["doc_id", "key"])
    return held.groupBy("doc_id", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "label"))), lambda x: x["label"]).alias("labels")).select("doc_id", "cluster", shown(F.col("labels")).alias("label"))


def replace(docs: DataFrame, numbers: DataFrame, shown, *, style: str = "bracketed", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with each run of adjacent citations replaced by its numbers: doc_id, text, missing.

    numbers: (doc_id, key, label). Styles: bracketed, superscript, superscript-bracketed. A
    cluster with an unknown key stays as it is and the key is listed in ``missing``.
    """
    run = r"(?:\\citep?\{[^{}]+\}\s*)*\\citep?\{[^{}]+\}"
    table = numbers.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "label"))).alias("labels"))
    wide = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(table, "doc_id", "left").withColumn("labels", F.coalesce("labels", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    keys = lambda c: F.flatten(F.transform(F.regexp_extract_all(c, F.lit(CITE), F.lit(1)), lambda g: F.filter(F.transform(F.split(g, ","), lambda k: F.trim(k)), lambda k: k != "")))

    def label(c: Column) -> Column:
        found = F.transform(keys(c), lambda k: F.col("labels")[k])
        text = shown(found)
        body = F.concat(F.lit("["), text, F.lit("]")) if style == "bracketed" else F.concat(F.lit("<sup>"), text, F.lit("</sup>")) if style == "superscript" else F.concat(F.lit("<sup>["), text, F.lit("]</sup>"))
        return F.when(F.exists(found, lambda x: x.isNull()), c).otherwise(body)

    around, inside = F.split("text", run, -1), F.regexp_extract_all("text", F.lit(run), F.lit(0))
    both = F.zip_with(around, F.transform(inside, label), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    missing = F.array_sort(F.array_distinct(F.filter(keys(F.col("text")), lambda k: F.col("labels")[k].isNull())))
    return wide.select("doc_id", F.array_join(both, "").alias("new"), missing.alias("missing")).withColumnRenamed("new", "text")


def label_index(main: DataFrame, aux: DataFrame) -> DataFrame:
    """label, value, source: the main document's labels win; those of the supplement also stand under S-label."""
    both = main.select("label", "value", F.lit("main").alias("source")).unionByName(aux.select("label", "value", F.lit("aux").alias("source"))).unionByName(aux.select(F.concat(F.lit("S-"), "label").alias("label"), "value", F.lit("aux").alias("source")))
    best = F.row_number().over(Window.partitionBy("label").orderBy(F.when(F.col("source") == "main", 0).otherwise(1), "value"))
    return both.withColumn("r", best).where("r = 1").drop("r")


def next_numbers(tables: DataFrame, reserved: DataFrame, prefix: str = "") -> DataFrame:
    """doc_id, ordinal, number: automatic table numbers that step over authored ones.

    tables: (doc_id, ordinal); reserved: (doc_id, label) like ``Table 5``. The k-th automatic
    table takes the k-th free number, by rank: no row is visited in turn.
    """
    taken = reserved.select("doc_id", F.regexp_extract(F.lower(F.regexp_replace("label", r"\s+", " ")), rf"^table {prefix.lower()}(\d+)$", 1).alias("n")).where("n <> ''").select("doc_id", F.col("n").cast("int").alias("n")).distinct()
    size = tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).join(taken.groupBy("doc_id").agg(F.count(F.lit(1)).alias("t")), "doc_id", "left").select("doc_id", (F.col("m") + F.coalesce("t", F.lit(0))).cast("int").alias("top"))
    free = size.select("doc_id", F.explode(F.sequence(F.lit(1), "top")).alias("n")).join(taken, ["doc_id", "n"], "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")))
    ranked = tables.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")))
    return ranked.join(free, ["doc_id", "k"]).select("doc_id", "ordinal", F.col("n").alias("number"), (F.col("n") != F.col("k")).alias("moved"))
