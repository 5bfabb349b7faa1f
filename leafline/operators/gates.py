"""Quality gates: each gives rows of one findings schema, with fingerprints that survive moved lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import lines

# Abbreviations that need no definition, and the pattern of one.
KNOWN = ["AI", "API", "DOI", "GPU", "ORCID", "PDF", "SI", "URL"]
ACRONYM = r"\b[A-Z][A-Z0-9-]{1,}\b"
# Prose rules as name, pattern, message.
STYLE_RULES = [
    ("EM_DASH", r"—|---", "Use an en dash for ranges or relations."),
    ("NUMERIC_HYPHEN_RANGE", r"(?<![\w.])\d+(?:\.\d+)?\s-\s\d+(?:\.\d+)?(?!\w)", "Use an en dash for numeric ranges."),
    ("UNICODE_SCRIPT", r"[⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉]", "Use native markup for subscripts and superscripts."),
]
# Reference kinds that may stay undefined.
IGNORED_KINDS = ["sec", "si", "alg", "eq", "sub"]
#: Letters beyond ASCII count as letters at a word's edge in every engine once they are folded.
FOLD = r"[À-ÖØ-öø-ɏͰ-῿぀-힯]"


def whitelist(spark, *more: list[str]) -> DataFrame:
    """acronym: the known ones and any configured lists, trimmed, empty ones left out."""
    words = sorted({w.strip() for part in (KNOWN, *more) for w in part if w.strip()})
    return spark.createDataFrame([(w,) for w in words], "acronym string")


def abbreviations(docs: DataFrame, allowed: DataFrame | list[str] | None = None, *, require_definition: bool = True, require_reuse: bool = False) -> DataFrame:
    """doc_id, line_no, acronym, rule, message: acronyms undefined, or defined and used once.

    One shuffle, on (document, acronym), after map-side counting.
    """
    prose = lines(docs, of=T.plain_text, name="line").where(F.col("line").rlike("[A-Z][A-Z0-9-]"))
    seen = prose.select("doc_id", "line_no", "line", F.explode(F.regexp_extract_all(F.regexp_replace("line", FOLD, "x"), F.lit(ACRONYM), F.lit(0))).alias("acronym"))
    if isinstance(allowed, DataFrame):
        seen = seen.join(allowed.select("acronym"), "acronym", "left_anti")
    else:
        seen = seen.where(~F.col("acronym").isin(KNOWN if allowed is None else allowed))
    defined = F.rlike("line", F.concat(F.lit(r"[A-Za-z][A-Za-z0-9 -]{2,}\(\s*"), F.col("acronym"), F.lit(r"\s*\)")))
    per = seen.groupBy("doc_id", "acronym").agg(F.count(F.lit(1)).alias("n"), F.bool_or(defined).alias("defined"), F.min("line_no").alias("line_no"))
    rule = F.when(F.lit(require_definition) & ~F.col("defined"), "ABBR_UNDEFINED").when(F.lit(require_reuse) & (F.col("n") == 1) & F.col("defined"), "ABBR_UNUSED")
    message = F.when(F.col("rule") == "ABBR_UNDEFINED", F.concat(F.lit("Define abbreviation "), F.col("acronym"), F.lit(" at first use."))).otherwise(F.concat(F.lit("Remove abbreviation "), F.col("acronym"), F.lit("; it is defined but not reused.")))
    return per.withColumn("rule", rule).where("rule is not null").select("doc_id", "line_no", "acronym", "rule", message.alias("message"))


def fingerprint(path: Column, rule: Column, excerpt: Column, token: Column) -> Column:
    return F.concat(rule, F.lit(":"), F.substring(F.sha2(F.concat_ws("|", path, rule, T.squeeze(excerpt), token), 256), 1, 20))


def style(docs: DataFrame, rules: list[tuple[str, str, str]] | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, line_no, rule, message, excerpt, token, fingerprint: a row for each match of each rule.

    Rules of a default's name replace it. The rules are a short array in the projection: no join.
    """
    named = {r[0]: r for r in [*STYLE_RULES, *(rules or [])]}
    prose = lines(docs, of=T.plain_line, name="excerpt").where("excerpt <> ''")
    hits = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(m).alias("message"), F.regexp_extract_all("excerpt", F.lit(p), F.lit(0)).alias("tokens")) for n, p, m in named.values()))
    found = prose.select("doc_id", "line_no", "excerpt", F.explode(F.filter(hits, lambda x: F.size(x["tokens"]) > 0)).alias("x")).select("doc_id", "line_no", "x.rule", "x.message", "excerpt", F.explode("x.tokens").alias("token"))
    where = F.col("doc_id").cast("string") if path is None else path
    return found.withColumn("fingerprint", fingerprint(where, F.col("rule"), F.col("excerpt"), F.col("token")))


def unresolved(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline does not hold."""
    return findings.join(baseline.select("fingerprint"), "fingerprint", "left_anti")


def baseline(findings: DataFrame) -> DataFrame:
    """What a baseline keeps: fingerprint, doc_id, line_no, rule, excerpt cut to 220."""
    return findings.select("fingerprint", "doc_id", "line_no", "rule", F.substring("excerpt", 1, 220).alias("excerpt"))


def declared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels(doc_id, label, kind), references(doc_id, label)) of TeX sources, comments left out."""
    src = docs.select("doc_id", F.array_join(F.transform(T.split_lines(F.col("text")), T.strip_comment), "\n").alias("t"))
    labels = src.select("doc_id", F.explode(F.regexp_extract_all("t", F.lit(r"\\label\{((?:fig|tab):[^}]+)\}"), F.lit(1))).alias("label")).withColumn("kind", F.substring("label", 1, 3))
    refs = src.select("doc_id", F.explode(F.regexp_extract_all("t", F.lit(r"\\ref\*?\{([^}]+)\}"), F.lit(1))).alias("label"))
    return labels, refs


def references(docs: DataFrame, main: DataFrame | None = None) -> DataFrame:
    """kind, label, message: undefined references, duplicate labels, and main-document floats never cited there.

    main: doc_id of the main documents; all documents if None.
    """
    labels, refs = declared(docs)
    of_main = lambda d: d if main is None else d.join(main.select("doc_id").distinct(), "doc_id", "left_semi")
    undefined = refs.select("label").distinct().join(labels.select("label"), "label", "left_anti").where(F.contains("label", F.lit(":")) & ~F.substring_index("label", ":", 1).isin(IGNORED_KINDS))
    twice = labels.groupBy("label").count().where("count > 1")
    uncited = of_main(labels).select("doc_id", "label", "kind").distinct().join(of_main(refs), ["doc_id", "label"], "left_anti")
    return (
        undefined.select(F.lit("reference").alias("kind"), "label", F.lit("references an undefined label").alias("message"))
        .unionByName(twice.select(F.lit("duplicate").alias("kind"), "label", F.lit("duplicate label").alias("message")))
        .unionByName(uncited.select("kind", "label", F.lit("main figure/table is never cited in main prose").alias("message")))
    )


def quote_errors(c: Column) -> Column:
    """Offsets (from 0) of quotation marks without a partner, by a fold over the text's quotes."""
    opens, closes = "“‘«", "”’»"
    chars = F.filter(F.transform(F.split(c, ""), lambda x, i: F.struct(i.alias("at"), x.alias("c"))), lambda s: s["c"].isin(*opens, *closes))
    empty = F.array().cast("array<struct<at:int,c:string>>")
    start = F.struct(empty.alias("open"), F.array().cast("array<int>").alias("bad"))

    def step(acc, s):
        is_open = s["c"].isin(*opens)
        fits = (F.size(acc["open"]) > 0) & (F.translate(F.element_at(acc["open"], -1)["c"], opens, closes) == s["c"])
        pushed = F.concat(acc["open"], F.array(s))
        popped = F.slice(acc["open"], 1, F.greatest(F.size(acc["open"]) - 1, F.lit(0)))
        return F.struct(F.when(is_open, pushed).when(fits, popped).otherwise(acc["open"]).alias("open"), F.when(~is_open & ~fits, F.concat(acc["bad"], F.array(s["at"]))).otherwise(acc["bad"]).alias("bad"))

    return F.sort_array(F.aggregate(chars, start, step, lambda acc: F.concat(acc["bad"], F.transform(acc["open"], lambda s: s["at"]))))


def diagnostics(findings: DataFrame, code: Column, message: Column, severity: Column) -> DataFrame:
    """The common schema: severity normalised, absolute paths redacted, 32-hex fingerprint without lines."""
    level = F.when(F.lower(severity).isin("error", "fatal"), "error").when(F.lower(severity).isin("warning", "warn"), "warning").otherwise("info")
    text = T.redact_paths(message)
    return findings.select("*", level.alias("level"), code.alias("code"), text.alias("text")).withColumn("identity", F.substring(F.sha2(F.concat_ws("\u001f", "level", "code", "text", F.col("doc_id").cast("string")), 256), 1, 32))


def report(findings: DataFrame, group: str = "doc_id") -> DataFrame:
    """One row for each group: errors, warnings, status (pass, warn, fail)."""
    n = findings.groupBy(group).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return n.withColumn("status", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass"))


def escalate(findings: DataFrame, preserve: bool) -> DataFrame:
    """Under preserving fidelity, warnings of category loss become errors."""
    return findings.withColumn("level", F.when(F.lit(preserve) & (F.col("category") == "loss") & (F.col("level") == "warning"), "error").otherwise(F.col("level")))


def allows_publication(findings: DataFrame, policy: str = "error") -> DataFrame:
    """doc_id, allowed: policy error refuses any loss, which is an error or of category loss."""
    loss = F.bool_or((F.col("level") == "error") | (F.col("category") == "loss"))
    return findings.groupBy("doc_id").agg((~loss if policy == "error" else F.lit(True)).alias("allowed"))
