"""Scoring profiles: a small declarative language over metric rows."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.catalog import CONTRACT_VERSION
from orefold.functions.scalar import paths_selected
from orefold.operators.relational import gap_totals, threshold_gaps

#: Bytes a profile may have. A fixed value.
MAX_PROFILE = 1 << 20

TARGET_KINDS = ("file", "type", "member", "project", "namespace")
MODES = ("syntax", "semantic", "partial_semantic")
STABILITIES = ("semantic", "syntax_fallback", "line_fallback")
#: Names of the outputs on the wire and of their columns.
OUTPUTS = {"gapSum": "gap_sum", "squaredGapSum": "squared_gap_sum", "violatingTargetCount": "violating_targets", "maxTargetGap": "max_target_gap"}


class InvalidProfile(ValueError):
    """The profile breaks its schema or doesn't fit the metrics."""


class InvalidArtifacts(ValueError):
    """The artifacts break their contract."""


class PreconditionsNotMet(ValueError):
    """The run isn't one that the profile scores."""


@dataclass(frozen=True)
class Threshold:
    metric_id: str
    metric_version: str
    maximum: float
    weight: float
    tags: tuple[str, ...]


@dataclass(frozen=True)
class ThresholdDebt:
    target_kind: str
    thresholds: tuple[Threshold, ...]
    outputs: dict[str, str]


@dataclass(frozen=True)
class WeightedSum:
    terms: tuple[tuple[str, float], ...]
    output: str


@dataclass(frozen=True)
class Profile:
    id: str
    version: str
    modes: tuple[str, ...]
    stabilities: tuple[str, ...]
    include: list[str]
    exclude: list[str]
    require_trusted: bool
    min_targets: int
    primary: tuple[str, str]
    operations: tuple[ThresholdDebt | WeightedSum, ...]
    values: dict = field(default_factory=dict, compare=False)


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidProfile(message)


def _object(pairs: list[tuple[str, object]]) -> dict:
    _need(len({k for k, _ in pairs}) == len(pairs), "a property occurs twice")
    return dict(pairs)


def _fields(value: object, where: str, required: set[str], optional: set[str] = frozenset()) -> dict:
    _need(isinstance(value, dict), f"{where} must be an object")
    _need(required <= value.keys(), f"{where} lacks {sorted(required - value.keys())}")
    _need(value.keys() <= required | optional, f"{where} has unknown properties {sorted(value.keys() - required - optional)}")
    return value


def _text(value: object, where: str) -> str:
    _need(isinstance(value, str) and value.strip() != "", f"{where} must be text")
    return value


def _number(value: object, where: str) -> float:
    _need(isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value), f"{where} must be a finite number")
    return float(value)


def _version(value: object, where: str) -> str:
    _need(isinstance(value, str) and re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]+", value) is not None, f"{where} must be a three-part version")
    return value


def _texts(value: object, where: str, allowed: tuple[str, ...] = (), least: int = 0) -> list[str]:
    _need(isinstance(value, list) and len(value) >= least, f"{where} must be a list of {least} or more")
    items = [_text(v, where) for v in value]
    _need(len(set(items)) == len(items), f"{where} must not repeat items")
    _need(not allowed or set(items) <= set(allowed), f"{where} must be among {allowed}")
    return items


def parse_profile(text: str) -> Profile:
    """A checked profile: known properties only, outputs named once, inputs produced by earlier operations, the primary produced."""
    try:
        raw = json.loads(text.removeprefix("﻿"), object_pairs_hook=_object)
    except json.JSONDecodeError as e:
        raise InvalidProfile(f"not JSON: {e}") from e
    top = _fields(raw, "profile", {"schemaVersion", "id", "version", "artifactContractVersion", "allowedAnalysisModes", "allowedTargetIdStabilities", "selectors", "primary", "operations"})
    _need(top["schemaVersion"] == "1.0.0", "schemaVersion must be 1.0.0")
    _need(top["artifactContractVersion"] == CONTRACT_VERSION, f"artifactContractVersion must be {CONTRACT_VERSION}")
    sel = _fields(top["selectors"], "selectors", set(), {"includeFilePaths", "excludeFilePaths", "requireTrusted", "minTargetCount"})
    trusted, least = sel.get("requireTrusted", True), sel.get("minTargetCount", 1)
    _need(isinstance(trusted, bool), "requireTrusted must be a boolean")
    _need(isinstance(least, int) and not isinstance(least, bool) and least >= 1, "minTargetCount must be 1 or more")
    primary = _fields(top["primary"], "primary", {"key", "direction"})
    _need(primary["direction"] in ("minimize", "maximize"), "primary.direction must be minimize or maximize")
    _need(isinstance(top["operations"], list) and top["operations"], "operations must not be empty")
    produced: set[str] = set()
    operations: list[ThresholdDebt | WeightedSum] = []
    for n, op in enumerate(top["operations"]):
        where = f"operations[{n}]"
        _need(isinstance(op, dict) and op.get("operation") in ("thresholdDebt", "weightedSum"), f"{where} is unknown")
        if op["operation"] == "thresholdDebt":
            _fields(op, where, {"operation", "targetKind", "thresholds", "outputs"})
            _need(op["targetKind"] in TARGET_KINDS, f"{where}.targetKind must be among {TARGET_KINDS}")
            _need(isinstance(op["thresholds"], list) and op["thresholds"], f"{where}.thresholds must not be empty")
            limits = []
            for t in op["thresholds"]:
                _fields(t, f"{where}.thresholds", {"metricId", "metricVersion", "maximum"}, {"weight", "tags"})
                weight = _number(t.get("weight", 1), "weight")
                _need(weight > 0, "weight must be above 0")
                limits.append(Threshold(_text(t["metricId"], "metricId"), _version(t["metricVersion"], "metricVersion"), _number(t["maximum"], "maximum"), weight, tuple(sorted(_texts(t.get("tags", []), "tags")))))
            keys = [(t.metric_id, t.metric_version, t.tags) for t in limits]
            _need(len(set(keys)) == len(keys), f"{where} has one metric twice")
            outputs = _fields(op["outputs"], f"{where}.outputs", set(OUTPUTS))
            names = [_text(outputs[o], o) for o in OUTPUTS]
            operations.append(ThresholdDebt(op["targetKind"], tuple(limits), {o: outputs[o] for o in OUTPUTS}))
        else:
            _fields(op, where, {"operation", "terms", "output"})
            _need(isinstance(op["terms"], list) and op["terms"], f"{where}.terms must not be empty")
            terms = []
            for t in op["terms"]:
                _fields(t, f"{where}.terms", {"key", "weight"})
                terms.append((_text(t["key"], "key"), _number(t["weight"], "weight")))
                _need(t["key"] in produced, f"{where} uses '{t['key']}' before it is produced")
            names = [_text(op["output"], "output")]
            operations.append(WeightedSum(tuple(terms), op["output"]))
        _need(len(set(names)) == len(names) and not produced & set(names), f"{where} produces a value that exists")
        produced |= set(names)
    key = _text(primary["key"], "primary.key")
    _need(key in produced, f"the primary '{key}' is never produced")
    return Profile(
        _text(top["id"], "id"), _version(top["version"], "version"), tuple(_texts(top["allowedAnalysisModes"], "allowedAnalysisModes", MODES, 1)),
        tuple(_texts(top["allowedTargetIdStabilities"], "allowedTargetIdStabilities", STABILITIES, 1)), _texts(sel.get("includeFilePaths", []), "includeFilePaths"),
        _texts(sel.get("excludeFilePaths", []), "excludeFilePaths"), trusted, least, (key, primary["direction"]), tuple(operations),
    )


def selected(metrics: DataFrame, nodes: DataFrame, profile: Profile) -> DataFrame:
    """Metric rows of the targets that the file selectors choose: every declaration matches an include, and none an exclude."""
    rows = metrics.where(F.col("target_kind").isin(*TARGET_KINDS))
    if not profile.include and not profile.exclude:
        return rows
    paths = F.when(F.col("declarations").isNotNull(), F.array_distinct(F.col("declarations.file_path"))).when((F.col("kind") != "project") & F.col("file_path").isNotNull(), F.array("file_path"))
    placed = nodes.where(F.col("kind").isin(*TARGET_KINDS)).select(F.col("id").alias("target_id"), F.col("kind").alias("__kind"), paths.alias("__paths"))
    lacking = placed.where("__kind <> 'project' AND (__paths IS NULL OR size(__paths) = 0)").join(rows.select("target_id").distinct(), "target_id", "left_semi")
    if (gap := lacking.limit(1).collect()):
        raise PreconditionsNotMet(f"file selectors need declaration paths, which target '{gap[0].target_id}' lacks")
    chosen = placed.where("size(__paths) > 0").where(paths_selected(F.col("__paths"), profile.include, profile.exclude)).select("target_id").distinct()
    return rows.join(chosen, "target_id", "left_semi")


def evaluate(profile: Profile, metrics: DataFrame, nodes: DataFrame, health: dict, mode: str) -> dict[str, object]:
    """Values by key in order, the primary, and where each came from. metrics and nodes are one run's; one aggregate runs per thresholdDebt.

    Gaps of a target add up in the order of its thresholds, targets in the order of the plan, so sums may differ in the last digits.
    """
    if profile.require_trusted and not (health.get("analysis_quality") == "trusted" and health.get("trusted_diagnostics")):
        raise PreconditionsNotMet("the profile needs a trusted analysis with trusted diagnostics")
    if mode not in profile.modes:
        raise PreconditionsNotMet(f"mode {mode} isn't allowed by the profile")
    chosen = selected(metrics, nodes, profile)
    kinds = {o.target_kind for o in profile.operations if isinstance(o, ThresholdDebt)} & {"type", "member", "namespace"}
    odd = chosen.where(F.col("target_kind").isin(*kinds)).where(~F.col("target_id_stability").isin(*profile.stabilities)).select("target_id_stability").distinct() if kinds else None
    if odd is not None and (found := odd.collect()):
        raise PreconditionsNotMet(f"stabilities {sorted(r.target_id_stability for r in found)} aren't allowed by the profile")
    values: dict[str, float] = {}
    provenance = []
    tags = F.array_join(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), "\0")
    tagged = chosen.withColumn("__tags", tags)
    for n, op in enumerate(profile.operations):
        if isinstance(op, WeightedSum):
            total = 0.0
            for key, weight in op.terms:
                total += values[key] * weight
            _finite(total, n)
            values[op.output] = total
            provenance.append({"index": n, "operation": "weightedSum", "inputs": [k for k, _ in op.terms], "outputs": [op.output]})
            continue
        everywhere = metrics.where(F.col("target_kind") == op.target_kind).withColumn("__tags", tags)
        for t in op.thresholds:
            of = everywhere.where((F.col("metric_id") == t.metric_id) & (F.col("metric_version") == t.metric_version) & (F.col("__tags") == "\0".join(t.tags)))
            if not of.limit(1).count():
                raise InvalidProfile(f"metric {t.metric_id}@{t.metric_version} {list(t.tags)} isn't available for {op.target_kind}")
        limits = metrics.sparkSession.createDataFrame([(t.metric_id, t.metric_version, "\0".join(t.tags), t.maximum, t.weight, i) for i, t in enumerate(op.thresholds)], "metric_id string, metric_version string, __tags string, maximum double, weight double, place int")
        of_kind = tagged.where(F.col("target_kind") == op.target_kind)
        checks = [F.count("*").alias("rows"), F.count_distinct("place").alias("places"), F.count("numeric_value").alias("numbers"), F.min("file_path").alias("p0"), F.max("file_path").alias("p1")]
        per = threshold_gaps(of_kind, F.broadcast(limits), ["metric_id", "metric_version", "__tags"], ["target_id"], "numeric_value", checks)  # the profile's thresholds
        targets = of_kind.select("target_id").distinct().join(per, "target_id", "left")
        k = len(op.thresholds)
        r = targets.agg(
            F.count("*").alias("targets"), F.count_if((F.coalesce("places", F.lit(0)) != k) | (F.coalesce("numbers", F.lit(0)) != F.coalesce("rows", F.lit(0)))).alias("lacking"), F.count_if(F.col("rows") > k).alias("twice"),
            F.count_if(F.col("p0") != F.col("p1")).alias("moved"), *gap_totals(),
        ).first()
        if r.targets < profile.min_targets:
            raise PreconditionsNotMet(f"operations[{n}] selects {r.targets} targets, fewer than {profile.min_targets}")
        if r.moved or r.twice:
            raise InvalidArtifacts(f"a target of operations[{n}] has metrics of several paths, or one metric twice")
        if r.lacking:
            raise InvalidArtifacts(f"{r.lacking} targets of operations[{n}] lack a metric of its thresholds")
        for o in OUTPUTS:
            values[op.outputs[o]] = float(r[OUTPUTS[o]])
            _finite(float(r[OUTPUTS[o]]), n)
        provenance.append({"index": n, "operation": "thresholdDebt", "inputs": [f"{t.metric_id}@{t.metric_version}" for t in op.thresholds], "outputs": [op.outputs[o] for o in OUTPUTS], "targetKind": op.target_kind, "selectedTargetCount": r.targets})
    return {"profile": f"{profile.id}@{profile.version}", "values": dict(sorted(values.items())), "primary": {"key": profile.primary[0], "direction": profile.primary[1], "value": values[profile.primary[0]]}, "provenance": provenance}


def _finite(value: float, n: int) -> None:
    if not math.isfinite(value):
        raise PreconditionsNotMet(f"operations[{n}] gives a value that isn't finite")
