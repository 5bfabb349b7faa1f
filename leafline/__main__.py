"""python -m leafline: gates, conversion, audits and pipelines over files.

Exit codes: 0 nothing found, 1 findings or a failed pipeline, 2 a wrong call or input.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafline", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    gate = sub.add_parser("gate", help="check sources")
    gate.add_argument("kind", choices=["abbr", "style", "references"])
    gate.add_argument("path")
    gate.add_argument("--config", help="JSON: abbr-whitelist, rules, main_document")
    gate.add_argument("--baseline", help="table of accepted fingerprints")
    gate.add_argument("--write-baseline", help="where to write one")
    conv = sub.add_parser("convert", help="convert sources to Markdown or TeX")
    conv.add_argument("path")
    conv.add_argument("output")
    conv.add_argument("--source", choices=["markdown", "latex"], default="markdown")
    conv.add_argument("--target", choices=["markdown", "latex"], required=True)
    conv.add_argument("--loss", choices=["error", "warn", "drop"], default="warn")
    aud = sub.add_parser("audit", help="check Word packages")
    aud.add_argument("path")
    exp = sub.add_parser("export", help="Word packages as Markdown texts")
    exp.add_argument("path")
    exp.add_argument("output")
    bmap = sub.add_parser("export-block-map", help="keys and opaque blocks of Word packages")
    bmap.add_argument("path")
    bmap.add_argument("output")
    red = sub.add_parser("redline", help="edits between two folders of Word packages of the same names")
    red.add_argument("base")
    red.add_argument("current")
    red.add_argument("output")
    delta = sub.add_parser("plan-delta", help="replacements that edited Markdown asks for")
    delta.add_argument("base")
    delta.add_argument("edited")
    delta.add_argument("output")
    delta.add_argument("--allow-delete", action="store_true")
    chk = sub.add_parser("check", help="headings, relationships and review state of Word packages")
    chk.add_argument("path")
    sli = sub.add_parser("slides", help="read and check JSON lists of slides")
    sli.add_argument("path")
    pub = sub.add_parser("publish", help="convert and publish as a release")
    pub.add_argument("path")
    pub.add_argument("root")
    pub.add_argument("--source", choices=["markdown", "latex", "docx"], default="markdown")
    pub.add_argument("--target", choices=["markdown", "latex"], required=True)
    pub.add_argument("--fidelity", choices=["best", "preserve"], default="best")
    pub.add_argument("--force", action="store_true")
    pack = sub.add_parser("sourcepack", help="manifest of allowed files")
    pack.add_argument("path")
    pack.add_argument("output")
    pack.add_argument("--allow", action="append", required=True)
    pipe = sub.add_parser("pipeline", help="run a specification")
    pipe.add_argument("spec")
    pipe.add_argument("path")
    pipe.add_argument("--plugin", action="append", default=[], help="MODULE:FUNCTION that fills the registry")
    return p


def shown(found, faults: str = "true") -> int:
    """Show rows and tell whether any is a fault, working them out once."""
    found = found.cache()
    found.show(50, truncate=120)
    n = found.where(faults).limit(1).count()
    found.unpersist()
    return int(n > 0)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from . import api
    from .operators import aggregates, align, delta, gates, lines, review
    from .plans import pipeline
    from .sources import docx, files

    spark = SparkSession.builder.appName("leafline").getOrCreate()
    try:
        if a.command == "gate":
            docs = files.documents(spark, a.path)
            config = json.loads("".join(r.value for r in spark.read.text(a.config, wholetext=True).collect())) if a.config else {}
            if a.kind == "abbr":
                found = gates.abbreviations(docs, gates.whitelist(spark, config.get("abbr-whitelist", [])))
            elif a.kind == "style":
                found = gates.style(docs, [(n, r["pattern"], r.get("message", n)) for n, r in config.get("rules", {}).items()])
                if a.write_baseline:
                    gates.baseline(found).write.mode("overwrite").parquet(a.write_baseline)
                if a.baseline:
                    found = gates.unresolved(found, spark.read.parquet(a.baseline))
            else:
                main_doc = docs.where(F.col("path").endswith(config["main_document"])).select("doc_id") if config.get("main_document") else None
                found = gates.references(docs, main_doc)
            return shown(found)
        if a.command == "convert":
            api.convert(files.documents(spark, a.path), a.source, a.target, a.loss).write.mode("errorifexists").parquet(a.output)
            return 0
        if a.command == "audit":
            return shown(docx.audit(files.binaries(spark, a.path, "*.docx")))
        if a.command == "export":
            api.convert(files.binaries(spark, a.path, "*.docx"), "docx", "markdown").write.mode("errorifexists").parquet(a.output)
            return 0
        if a.command == "export-block-map":
            docx.block_map(files.binaries(spark, a.path, "*.docx")).drop("text").write.mode("errorifexists").parquet(a.output)
            return 0
        if a.command == "redline":
            base, current = (docx.versions(files.binaries(spark, p, "*.docx")) for p in (a.base, a.current))
            edits = align.align_versions(base, current)
            matched = edits.join(base.select("doc_id", F.col("ordinal").alias("base_ordinal"), F.col("text").alias("base_text")), ["doc_id", "base_ordinal"], "left").join(current.select("doc_id", F.col("ordinal").alias("current_ordinal"), F.col("text").alias("current_text")), ["doc_id", "current_ordinal"], "left")
            words = align.redline(matched.select("doc_id", F.col("step").alias("ordinal"), "base_text", "current_text")).withColumnRenamed("ordinal", "step")
            edits.join(words, ["doc_id", "step"]).write.mode("errorifexists").parquet(a.output)
            return 0
        if a.command == "plan-delta":
            base, edited = (lines.chunks(files.documents(spark, p).withColumn("doc_id", F.xxhash64(F.regexp_extract("path", r"([^/]+)$", 1)))) for p in (a.base, a.edited))
            delta.plan_delta(base, edited, a.allow_delete).write.mode("errorifexists").parquet(a.output)
            return int(spark.read.parquet(a.output).where("op = 'refused'").limit(1).count() > 0)
        if a.command == "check":
            held = files.binaries(spark, a.path, "*.docx")
            revised = docx.blocks(held).where("revised").select("path", F.lit("docx.revisions").alias("code"), F.lit("").alias("owner"), F.col("ordinal").cast("string").alias("item"))
            outline = review.heading_findings(docx.semantic(held)).select(F.col("doc_id").cast("string").alias("path"), "code", F.lit("").alias("owner"), F.col("ordinal").cast("string").alias("item"))
            broken = docx.blocks(held).where("error is not null").select("path", F.col("error").alias("code"), F.lit("").alias("owner"), F.lit("").alias("item"))
            return shown(docx.audit(held).unionByName(revised).unionByName(outline).unionByName(broken))
        if a.command == "slides":
            return shown(files.slides(files.documents(spark, a.path)), "error is not null")
        if a.command == "publish":
            docs = files.binaries(spark, a.path, "*.docx") if a.source == "docx" else files.documents(spark, a.path)
            held = api.write(spark, docs, a.source, a.target, a.root, fidelity=a.fidelity, command=" ".join(argv or sys.argv[1:]), force=a.force)
            sys.stdout.write(f"release {held['version']}\n")
            return 0
        if a.command == "sourcepack":
            aggregates.source_pack(files.binaries(spark, a.path), a.allow).coalesce(1).write.mode("errorifexists").option("header", True).csv(a.output)
            return 0
        registry = pipeline.Registry()
        for plugin in a.plugin:
            module, _, name = plugin.partition(":")
            getattr(importlib.import_module(module), name)(registry)
        spec = pipeline.Spec.from_json("".join(r.value for r in spark.read.text(a.spec, wholetext=True).collect()))
        got = pipeline.Runner(registry).run(spark, spec, {"documents": files.documents(spark, a.path)})
        sys.stdout.write(pipeline.report_text(got.manifest))
        return int(got.status == "fail")
    except (ValueError, KeyError, ImportError, AnalysisException) as e:
        sys.stderr.write(f"leafline: {str(e).splitlines()[0]}\n")
        return 2


if __name__ == "__main__":
    sys.exit(main())
