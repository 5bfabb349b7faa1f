"""Reading, converting and auditing documents by format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import blocks as B
from .sources import bibtex, docx, files, latex, markdown

LOSS_POLICIES = ("error", "warn", "drop")


def default_loss_policy(fidelity: str) -> str:
    return "error" if fidelity == "preserve" else "warn"


def read(docs: DataFrame, source: str) -> DataFrame:
    """Block rows of (doc_id, text) in a source format, or of (path, content) packages, under one schema."""
    if source == "markdown":
        return markdown.blocks(docs)
    if source == "latex":
        rows = latex.blocks(docs)
        return rows.select("doc_id", "ordinal", "kind", "text", "level", "cells", F.lit("").alias("language"), F.lit("").alias("path"), F.create_map(F.lit("label"), F.coalesce("label", F.lit(""))).alias("options"), F.transform(F.coalesce(F.try_element_at("cells", F.lit(1)), F.array().cast("array<string>")), lambda _: F.lit("")).alias("alignments"), F.col("code").alias("error"))
    if source == "docx":
        return docx.semantic(docs)
    raise ValueError(f"no reader for {source}")


def losses(blocks: DataFrame, target: str) -> DataFrame:
    """doc_id, ordinal, kind of blocks that a target cannot hold."""
    held = {"markdown": ["opaque", "float", "error"], "latex": ["opaque", "error"]}
    if target not in held:
        raise ValueError(f"no writer for {target}")
    return blocks.where(F.col("kind").isin(held[target])).select("doc_id", "ordinal", "kind")


def convert(docs: DataFrame, source: str, target: str, loss: str = "warn") -> DataFrame:
    """doc_id, text, n_losses; under ``error`` a document with a loss has no text, under ``drop`` losses are left out."""
    if loss not in LOSS_POLICIES:
        raise ValueError(f"loss must be one of {', '.join(LOSS_POLICIES)}")
    rows = read(docs, source)
    lost = losses(rows, target).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_losses"))
    kept = rows.join(losses(rows, target).select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_anti") if loss == "drop" else rows
    made = B.render_markdown(kept).withColumnRenamed("markdown", "out") if target == "markdown" else B.render_latex(kept).withColumnRenamed("latex", "out")
    ids = docs.select(F.xxhash64("path").alias("doc_id")) if source == "docx" else docs.select("doc_id")
    wide = ids.join(made, "doc_id", "left").join(lost, "doc_id", "left").withColumn("n_losses", F.coalesce("n_losses", F.lit(0)))
    text = F.coalesce("out", F.lit(""))
    return wide.select("doc_id", (F.when(F.col("n_losses") == 0, text) if loss == "error" else text).alias("text"), "n_losses")


def write(spark, docs: DataFrame, source: str, target: str, root: str, *, fidelity: str = "best", command: str = "", force: bool = False) -> dict:
    """Convert and publish as one release of root: the texts and the losses of each document.

    Under ``preserve`` a document that loses anything keeps the release back.
    """
    from .plans import release

    rows = convert(docs, source, target, default_loss_policy(fidelity)).persist()
    lost = losses(read(docs, source), target)
    if fidelity == "preserve" and rows.where("n_losses > 0").limit(1).count():
        raise ValueError("release.blocked: losses under preserve")
    return release.publish(spark, root, {"texts": rows, "losses": lost}, command=command, force=force)


def audit(packages: DataFrame) -> DataFrame:
    return docx.audit(packages)


READERS = {"bibtex": bibtex.bibtex, "json": bibtex.json_entries, "slides": files.slides}
