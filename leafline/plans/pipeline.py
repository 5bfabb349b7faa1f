"""A fail-closed pipeline of stages over DataFrames, with artifacts, gates and a manifest."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "leafline.pipeline.v1"
PATHS = (re.compile(r"(?<![A-Za-z0-9_:/])/(?:[^/\s'\"]+/)*[^/\s'\"]+"), re.compile(r"(?<![A-Za-z0-9_])[A-Za-z]:[\\/][^\s'\"]*"))


def canonical(value: Any) -> Any:
    """JSON values with an order of their own: keys sorted, sets sorted by their JSON, NaN as text, absolute paths redacted."""
    if isinstance(value, dict):
        return {str(k): canonical(value[k]) for k in sorted(value, key=str)}
    if isinstance(value, (set, frozenset)):
        return sorted((canonical(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True, default=str))
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    if isinstance(value, float) and value != value:
        return "NaN"
    if isinstance(value, str):
        for p in PATHS:
            value = p.sub("<absolute-path>", value)
    return value


def canonical_json(value: Any) -> str:
    return json.dumps(canonical(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@dataclass(frozen=True)
class Stage:
    id: str
    kind: str
    depends_on: tuple[str, ...] = ()
    consumes: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    required: bool = True


@dataclass(frozen=True)
class Spec:
    stages: tuple[Stage, ...]
    gates: tuple[dict, ...] = ()
    validators: tuple[dict, ...] = ()
    required_artifacts: tuple[str, ...] = ()
    warnings_as_errors: bool = False

    @classmethod
    def from_json(cls, text: str) -> Spec:
        raw = json.loads(text)
        if raw.get("schema") != SCHEMA:
            raise ValueError(f"schema must be {SCHEMA}")
        tuples = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
        release = raw.get("release", {})
        return cls(tuple(Stage(**tuples(s)) for s in raw.get("stages", [])), tuple(raw.get("gates", [])), tuple(raw.get("validators", [])), tuple(release.get("required_artifacts", [])), bool(release.get("warnings_as_errors")))


class Registry:
    """Stages, gates and validators by name; a name is taken once."""

    def __init__(self):
        self.held: dict[tuple[str, str], Callable] = {}

    def add(self, category: str, name: str, fn: Callable) -> Callable:
        if (category, name) in self.held:
            raise ValueError(f"{category} {name} is registered already")
        self.held[category, name] = fn
        return fn

    def get(self, category: str, name: str) -> Callable | None:
        return self.held.get((category, name))


def layers(stages: tuple[Stage, ...]) -> list[Stage]:
    """Stages so that each follows what it depends on; ties keep the declared order."""
    done: set[str] = set()
    rest, out = list(stages), []
    while rest:
        ready = [s for s in rest if set(s.depends_on) <= done]
        if not ready:
            raise ValueError("pipeline.cycle: " + ", ".join(s.id for s in rest))
        out += ready
        done |= {s.id for s in ready}
        rest = [s for s in rest if s.id not in done]
    return out


def preflight(spec: Spec, registry: Registry, documents: set[str]) -> list[tuple[str, str]]:
    """(code, subject) of every fault of a specification; none may remain before anything runs."""
    faults: list[tuple[str, str]] = []
    ids = [s.id for s in spec.stages]
    faults += [("stage.duplicate_id", i) for i in sorted({i for i in ids if ids.count(i) > 1})]
    producer: dict[str, str] = {}
    for s in spec.stages:
        if registry.get("stage", s.kind) is None:
            faults.append(("stage.unknown_kind", s.id))
        faults += [("stage.self_dependency" if d == s.id else "stage.unknown_dependency", s.id) for d in s.depends_on if d == s.id or d not in ids]
        for p in s.produces:
            if p in producer:
                faults.append(("artifact.duplicate_output", p))
            producer[p] = s.id
    for category, parts in (("gate", spec.gates), ("validator", spec.validators)):
        faults += [(f"{category}.unknown_kind", str(g.get("id"))) for g in parts if registry.get(category, g.get("kind", "")) is None]
    if faults:
        return faults
    try:
        order = layers(spec.stages)
    except ValueError as e:
        return [("pipeline.cycle", str(e))]
    above: dict[str, set[str]] = {}
    for s in order:
        above[s.id] = set(s.depends_on).union(*(above[d] for d in s.depends_on), set())
        for c in s.consumes:
            if c not in documents and producer.get(c) not in above[s.id]:
                faults.append(("stage.input_not_upstream", f"{s.id}:{c}"))
    faults += [("release.artifact_missing", a) for a in spec.required_artifacts if a not in producer and a not in documents]
    return faults


@dataclass
class Result:
    status: str
    artifacts: dict[str, DataFrame]
    diagnostics: list[dict]
    manifest: dict
    #: All rows of each gate and validator.
    findings: dict[str, DataFrame] = field(default_factory=dict)


class Runner:
    """Runs a specification over named DataFrames.

    A stage is fn(inputs, parameters) -> {name: DataFrame}; a gate or validator is
    fn(artifacts, parameters) -> rows with severity, code and subject; the status follows from all of
    them. A stage that fails blocks all that
    depend on it, and the status is fail. With ``store`` each output is written as a table and
    read back, so later stages do not compute earlier ones again.
    """

    def __init__(self, registry: Registry, store: str | None = None):
        self.registry, self.store = registry, store

    def run(self, spark: SparkSession, spec: Spec, documents: dict[str, DataFrame]) -> Result:
        faults = preflight(spec, self.registry, set(documents))
        if faults:
            found = [{"severity": "error", "code": c, "subject": s} for c, s in faults]
            return Result("fail", {}, found, self.manifest(spec, {}, found, "fail"))
        held, found, states, findings = dict(documents), [], {}, {}
        keys = {name: content_key(df) for name, df in documents.items() if any(name in s.consumes for s in spec.stages)}
        for s in layers(spec.stages):
            if any(states.get(d) != "done" for d in s.depends_on):
                states[s.id] = "blocked"
                found.append({"severity": "error" if s.required else "warning", "code": "stage.blocked", "subject": s.id})
                continue
            try:
                out = self.registry.get("stage", s.kind)({k: held[k] for k in s.consumes}, s.parameters)
                if gone := [p for p in s.produces if p not in out]:
                    raise ValueError(f"stage gives no {', '.join(gone)}")
                key = stage_key(s, keys)
                for p in s.produces:
                    held[p], keys[p] = self.keep(spark, p, out[p]), digest([key, p])
                states[s.id] = "done"
            except Exception as e:
                states[s.id] = "failed"
                found.append({"severity": "error" if s.required else "warning", "code": "stage.failed", "subject": s.id, "message": canonical(str(e))[:500]})
        for category, parts in (("gate", spec.gates), ("validator", spec.validators)):
            for g in parts:
                try:
                    rows = self.registry.get(category, g["kind"])(held, g.get("parameters", {})).select("severity", "code", "subject")
                    findings[f"{category}:{g.get('id')}"] = rows = self.keep(spark, f"{category}-{g.get('id')}", rows)
                    found += self.summary(rows)
                except Exception as e:
                    found.append({"severity": "error" if g.get("required", True) else "warning", "code": f"{category}.unavailable", "subject": str(g.get("id")), "message": canonical(str(e))[:500]})
        found += [{"severity": "error", "code": "release.artifact_missing", "subject": a} for a in spec.required_artifacts if a not in held]
        levels = {d["severity"] for d in found}
        status = "fail" if "error" in levels or spec.warnings_as_errors and "warning" in levels else "warn" if "warning" in levels else "pass"
        return Result(status, held, found, self.manifest(spec, states, found, status, keys), findings)

    def summary(self, rows: DataFrame) -> list[dict]:
        """A diagnostic for each severity and code of all rows: how many there are and the first subject. The rows stay a table."""
        n = rows.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("count"), F.min("subject").alias("subject"))
        return [r.asDict() for r in n.orderBy("severity", "code").collect()]

    def keep(self, spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
        if self.store is None:
            return df
        df.write.mode("errorifexists").parquet(path := f"{self.store}/{name}")
        return spark.read.schema(df.schema).parquet(path)

    def manifest(self, spec: Spec, states: dict, found: list[dict], status: str, keys: dict[str, str] | None = None) -> dict:
        stages = [{"id": s.id, "kind": s.kind, "state": states.get(s.id, "not_run"), "key": stage_key(s, keys or {})} for s in spec.stages]
        body = {"schema": SCHEMA, "stages": stages, "diagnostics": sorted(found, key=canonical_json), "status": status}
        return body | {"semantic_hash": digest(body)}


def content_key(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order: one pass, combined where the rows are."""
    row = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}))
    n = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
    return digest([sorted(df.columns), n["n"], n["x"], str(n["s"])])


def stage_key(stage: Stage, keys: dict[str, str]) -> str:
    """What a stage's result follows from: its kind and parameters, and the keys of what it reads."""
    return digest([stage.id, stage.kind, stage.parameters, [[c, keys.get(c, "")] for c in stage.consumes]])


def report_text(manifest: dict) -> str:
    lines = [f"status: {manifest['status']}", *(f"stage {s['id']}: {s['state']}" for s in manifest["stages"])]
    more = lambda d: f" ({d['count']})" if d.get("count", 1) > 1 else ""
    return "\n".join([*lines, *(f"{d['severity']} {d['code']} {d.get('subject') or ''}".rstrip() + more(d) for d in manifest["diagnostics"])]) + "\n"
