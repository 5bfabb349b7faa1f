"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations.

A test item of n distinct word shingles counts as leaked if at least ``threshold`` of them stand
in a document. Items are partitioned by size (classes of powers of two), and each class has sketch
parameters of its own: an item is sketched by its n - need + r smallest hashes (a bottom-k
MinHash), where r grows with the class. A document that holds ``need`` = ceil(threshold * n)
shingles misses at most n - need, so r hashes of the sketch stand in it at least: no pair is lost,
however long the document, and short items ask for one common hash while long ones ask for
several. The documents' side of the search is a MinHash sketch too: of each document only the
hashes up to the largest that any class's sketches hold take part.

Candidates are verified by exact containment, on the words of all the item's shingles. The item
side is broadcast where it is counted to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, staged

#: Signs between words. Letters and digits of any script make words.
GAPS = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def _runs(df: DataFrame, of: Column, width: int, *keys: str) -> DataFrame:
    """keys and w0 to w{width - 1}: each run of ``width`` elements of an array, side by side."""
    held = df.select(*keys, of.alias("run")).where(F.size("run") >= width)
    n = F.greatest(F.size("run") - width + 1, F.lit(0))
    return held.select(*keys, F.inline(F.arrays_zip(*(F.slice("run", k + 1, n).alias(f"w{k}") for k in range(width)))))


def shingle_hashes(df: DataFrame, text: str, width: int, *keys: str) -> DataFrame:
    """keys and h, a hash of each run of ``width`` words, repeats included; none if there are fewer words.

    Words are hashed once; runs are columns side by side, so that hashing them is compiled code.
    """
    hashed = F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w))
    return _runs(df, hashed, width, *keys).select(*keys, F.xxhash64(*(f"w{k}" for k in range(width))).alias("h"))


def shingles(df: DataFrame, text: str, width: int, *keys: str) -> DataFrame:
    """keys, h and shingle: distinct runs of words with the hashes of shingle_hashes."""
    w = [f"w{k}" for k in range(width)]
    return _runs(df, words_of(F.col(text)), width, *keys).select(*keys, F.xxhash64(*(F.xxhash64(x) for x in w)).alias("h"), F.concat_ws(" ", *w).alias("shingle")).distinct()


def sketched(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(sizes(item_id, n_shingles, need, r), sketches(item_id, h)) of items(item_id, h, shingle)."""
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"), F.sort_array(F.collect_list("h")).alias("hs"))
    n, need = F.col("n_shingles"), F.ceil(F.col("n_shingles") * threshold - 1e-9).cast("int")
    size_class = F.floor(F.log2(n))
    r = F.least(F.greatest(F.pow(F.lit(2), size_class - 3), F.lit(1)).cast("int"), need)
    sizes = staged(sizes.withColumn("need", need).withColumn("r", r), items.count())
    hashes = F.slice("hs", 1, n.cast("int") - F.col("need") + F.col("r"))  # an item's hashes are one short sorted array
    return sizes.drop("hs"), staged(sizes.select("item_id", F.explode(hashes).alias("h")), items.count())


def leaked_items(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    width: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """Pairs of documents and items they hold: doc_id, item_id, n_shingles, n_found, containment.

    Words are runs of letters and digits, lower-cased. Repeats of a shingle count once.

    Defined cases: null texts and texts of fewer than ``width`` words have no shingles, so such
    items are never found and such documents hold none; repeated document ids are taken as one
    document; repeated item ids as one item of all their shingles; null ids are left out; other
    columns are not read; an empty table on either side gives no rows.
    """
    named = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null")
    items = staged(shingles(named, "text", width, "item_id"), 100 * named.count())
    sizes, sketches = sketched(items, threshold)
    top = sketches.agg(F.max("h")).first()[0]
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    if top is None:
        top = -(1 << 63)

    # The document's sketch: hashes up to the largest that any class asks for.
    runs = shingle_hashes(held, "text", width, "doc_id").where(F.col("h") <= F.lit(top))
    hits = runs.join(maybe_broadcast(sketches), "h").groupBy("doc_id", "item_id", "h").agg(F.lit(1).alias("x"))
    pairs = hits.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("hits")).join(maybe_broadcast(sizes), "item_id")
    pairs = staged(pairs.where(F.col("hits") >= F.col("r")).select("doc_id", "item_id", "n_shingles", "need"))

    asked = pairs.join(maybe_broadcast(items), "item_id")
    again = held.join(maybe_broadcast(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    known = shingles(again, "text", width, "doc_id").join(maybe_broadcast(items.select("h").distinct()), "h", "left_semi")
    found = asked.join(known, ["doc_id", "h", "shingle"]).groupBy("doc_id", "item_id")
    counted = found.agg(F.first("n_shingles").alias("n_shingles"), F.first("need").alias("need"), F.count(F.lit(1)).alias("n_found"))
    return counted.where("n_found >= need").select("doc_id", "item_id", "n_shingles", "n_found", F.round(F.col("n_found") / F.col("n_shingles"), 6).alias("containment"))
