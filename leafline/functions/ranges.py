"""Runs of consecutive numbers, in the dialects that citation styles use.

All are one fold over a sorted array, so a row's labels never leave the row. A label is a prefix
and a number; what has neither stands alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUNS = "array<struct<prefix:string,low:bigint,high:bigint,first:string,last:string>>"


def parsed(labels: Column) -> Column:
    """struct(class, n, prefix, label): plain numbers, then prefixed, then others."""

    def one(x):
        prefix, n = F.regexp_extract(x, r"^([A-Za-z]*)\d+$", 1), F.try_to_number(F.regexp_extract(x, r"^[A-Za-z]*(\d+)$", 1), F.lit("999999999999999999")).cast("long")
        return F.struct(F.when(n.isNull(), 2).when(prefix == "", 0).otherwise(1).alias("class"), F.coalesce(n, F.lit(0)).alias("n"), F.when(n.isNull(), x).otherwise(prefix).alias("prefix"), x.alias("label"))

    return F.transform(labels, one)


def runs(items: Column) -> Column:
    """Fold parsed labels, in their order, to runs of one prefix and step one."""

    def add(acc, x):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x["class"] < 2) & (last["prefix"] == x["prefix"]) & (last["high"] + 1 == x["n"])
        longer = F.struct(last["prefix"].alias("prefix"), last["low"].alias("low"), x["n"].alias("high"), last["first"].alias("first"), x["label"].alias("last"))
        fresh = F.struct(x["prefix"].alias("prefix"), x["n"].alias("low"), x["n"].alias("high"), x["label"].alias("first"), x["label"].alias("last"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(fresh)))

    return F.aggregate(items, F.array().cast(_RUNS), add)


def collapse(labels: Column, *, least: int, ordered: bool = True, brackets: bool = False) -> Column:
    """Comma-joined labels; a run of ``least`` or more becomes first–last.

    ordered: sort and drop repeats first; otherwise the given order stays.
    """
    items = F.array_sort(F.array_distinct(parsed(labels))) if ordered else parsed(labels)

    def shown(r):
        n = r["high"] - r["low"] + 1
        every = F.array_join(F.transform(F.sequence(r["low"], r["high"]), lambda i: F.concat(r["prefix"], i.cast("string"))), ",")
        return F.when(n == 1, r["first"]).when(n >= least, F.concat(r["first"], F.lit("–"), r["last"])).otherwise(every)

    text = F.array_join(F.transform(runs(items), shown), ",")
    return F.when(F.size(labels) > 0, F.concat(F.lit("["), text, F.lit("]"))).otherwise("") if brackets else text


def bracketed(labels: Column) -> Column:
    """Sorted, ranges from three: 1,2,4,5,6 is [1,2,4–6]."""
    return collapse(labels, least=3, brackets=True)


def sorted_pairs(labels: Column) -> Column:
    """Sorted, ranges from two: 1,2 is 1–2."""
    return collapse(labels, least=2)


def in_order(numbers: Column) -> Column:
    """Given order, ranges from three."""
    return collapse(F.transform(numbers, lambda x: x.cast("string")), least=3, ordered=False)


def linked_parts(labels: Column) -> Column:
    """(text, link) parts, ranges from two; a range links to its first label."""
    return F.transform(runs(F.array_sort(F.array_distinct(parsed(labels)))), lambda r: F.struct(F.when(r["low"] == r["high"], r["first"]).otherwise(F.concat(r["first"], F.lit("–"), r["last"])).alias("text"), r["first"].alias("link")))


def numbers_of(text: Column) -> Column:
    """``1–3,7`` to [1, 2, 3, 7]; null if malformed or falling."""
    pieces = F.split(F.replace(text, F.lit("–"), F.lit("-")), ",")
    ends = lambda p: F.split(p, "-")
    low, high = lambda p: F.try_element_at(ends(p), F.lit(1)).cast("long"), lambda p: F.try_element_at(ends(p), F.lit(-1)).cast("long")
    falls = F.exists(pieces, lambda p: F.contains(p, F.lit("-")) & (high(p) <= low(p)))
    good = text.rlike(r"^\d+(?:[–-]\d+)?(?:,\d+(?:[–-]\d+)?)*$")
    return F.when(F.when(good, ~falls).otherwise(False), F.flatten(F.transform(pieces, lambda p: F.sequence(low(p), high(p)))))
