"""Publishing: a release is a folder of tables that one appended row commits, so readers see all of it or none.

A root holds ``releases/<version>/<name>`` and the log ``commits``. Writing a release touches no
earlier one; the log names the version and the one before it, so a release can be taken back by
committing its predecessor again. Everything goes through Spark's own readers and writers, so a root
may stand in any store.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pipeline import Result, canonical_json, content_key, digest

COMMITS = "version long, previous long, manifest string, sha256 string"


def copy_artifact(inputs: dict[str, DataFrame], parameters: dict) -> dict[str, DataFrame]:
    """The identity stage: what it reads, under the name that ``as`` gives."""
    (name, df), *more = inputs.items()
    if more:
        raise ValueError("copy takes one input")
    return {parameters.get("as", name): df}


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The log of a root; a root that is not there yet has none."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{root}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def current(spark: SparkSession, root: str) -> dict | None:
    """Version, previous version and manifest of the release that holds; None before the first."""
    # An append is one row, and the largest commit is the last: a taken-back release is committed again under a new number.
    row = commits(spark, root).orderBy(F.desc("version")).first()
    return None if row is None else {"version": row["version"], "previous": row["previous"], **json.loads(row["manifest"])}


def entry(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of the release that holds."""
    held = current(spark, root)
    if held is None or name not in held["tables"]:
        raise KeyError(f"release.artifact_missing: {name}")
    return spark.read.parquet(f"{root}/{held['tables'][name]['path']}")


def distinct_paths(names: list[str], root: str, sources: list[str]) -> None:
    """Outputs are distinct and none is a source."""
    clean = lambda p: "/".join(x for x in p.replace("\\", "/").split("/") if x not in ("", "."))
    paths = [clean(f"{root}/releases/{n}") for n in names]
    if len({p.lower() for p in paths}) < len(paths):
        raise ValueError("paths.not_distinct")
    held = {clean(s) for s in sources}
    if clean(root) in held or any(clean(root).startswith(h + "/") or h.startswith(clean(root) + "/releases/") for h in held):
        raise ValueError("paths.output_is_source")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], *, command: str = "", sources: list[str] | None = None, force: bool = False) -> dict:
    """Write tables as the next release and commit it. A root of other content is refused; equal content makes no release unless forced."""
    distinct_paths(sorted(tables), root, sources or [])
    held = current(spark, root)
    keys = {name: content_key(df) for name, df in sorted(tables.items())}
    if held and not force and {n: t["sha256"] for n, t in held["tables"].items()} == keys:
        return held
    version = (held["version"] if held else 0) + 1
    written = {}
    for name, df in sorted(tables.items()):
        path = f"releases/{version}/{name}"
        df.write.mode("overwrite").parquet(f"{root}/{path}")  # what a broken attempt left under this number was never committed
        written[name] = {"path": path, "sha256": keys[name], "rows": spark.read.parquet(f"{root}/{path}").count()}
    return _commit(spark, root, version, held["version"] if held else None, {"tables": written, "command": command})


def _commit(spark: SparkSession, root: str, version: int, previous: int | None, manifest: dict) -> dict:
    text = canonical_json(manifest)
    spark.createDataFrame([(version, previous, text, digest(manifest))], COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return {"version": version, "previous": previous, **manifest}


def take_back(spark: SparkSession, root: str) -> dict:
    """Commit the previous release again."""
    log = {r["version"]: r for r in commits(spark, root).collect()}  # one row a release
    last = log[max(log)] if log else None
    if last is None or last["previous"] is None:
        raise ValueError("release.no_previous")
    before = log[last["previous"]]
    return _commit(spark, root, last["version"] + 1, before["previous"], json.loads(before["manifest"]))


def publish_result(spark: SparkSession, root: str, result: Result, names: list[str], **how) -> dict:
    """Publish artifacts of a run and its findings; a run that failed publishes nothing."""
    if result.status == "fail":
        raise ValueError("release.blocked: the run failed")
    tables = {n: result.artifacts[n] for n in names} | {f"findings-{k.replace(':', '-')}": df for k, df in result.findings.items()}
    return publish(spark, root, tables, **how)


def sidecars(files: DataFrame, inputs: DataFrame, command: str) -> DataFrame:
    """path, kind, text of what goes beside each output: a manifest (JSON) and a checksum line, as one table that is written at once.

    files: (path, size, sha256) of outputs; inputs: (path, input, sha256) of what each was made from.
    """
    made = inputs.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.col("input").alias("path"), "sha256"))).alias("inputs"))
    wide = files.join(made, "path", "left")
    body = F.to_json(F.struct(F.lit(command).alias("command"), F.coalesce("inputs", F.array().cast("array<struct<path:string,sha256:string>>")).alias("inputs"), F.struct("path", "sha256", "size").alias("output")))
    both = F.array(F.struct(F.lit("manifest").alias("kind"), F.concat("path", F.lit(".manifest.json")).alias("name"), body.alias("text")), F.struct(F.lit("checksum").alias("kind"), F.concat("path", F.lit(".sha256")).alias("name"), F.concat("sha256", F.lit("  "), "path").alias("text")))
    return wide.select(F.explode(both).alias("x")).select("x.name", "x.kind", "x.text")


def register(registry) -> None:
    """Put the stages of this module into a registry."""
    registry.add("stage", "copy", copy_artifact)
