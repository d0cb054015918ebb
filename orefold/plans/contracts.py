"""Shapes of the small documents of a run, checked on the driver; the large artifacts are checked as DataFrames (validate.py)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from orefold.catalog import CONTRACT_VERSION

#: Objects and arrays within each other that a document may have. A fixed value.
MAX_DEPTH = 64

Check = Callable[[object], bool]


def text(v: object) -> bool:
    return isinstance(v, str) and v != ""


def flag(v: object) -> bool:
    return isinstance(v, bool)


def whole(least: int) -> Check:
    return lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= least


def number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)


def share(v: object) -> bool:
    return number(v) and 0 <= v <= 1


def among(*allowed: str) -> Check:
    return lambda v: v in allowed


def like(pattern: str) -> Check:
    return lambda v: isinstance(v, str) and re.fullmatch(pattern, v) is not None


@dataclass(frozen=True)
class Shape:
    """An object: properties that must and that may be there, each with a check, a shape, or a list of one; others are unknown."""

    required: dict = field(default_factory=dict)
    optional: dict = field(default_factory=dict)


def problems(value: object, shape, where: str) -> Iterator[str]:
    """What is wrong with a value, by the path of the property."""
    if isinstance(shape, Shape):
        if not isinstance(value, dict):
            yield f"{where} is no object"
            return
        yield from (f"{where} lacks {name}" for name in sorted(shape.required.keys() - value.keys()))
        yield from (f"{where}.{name} is unknown" for name in sorted(value.keys() - shape.required.keys() - shape.optional.keys()))
        for name, part in {**shape.required, **shape.optional}.items():
            if name in value:
                yield from problems(value[name], part, f"{where}.{name}")
    elif isinstance(shape, list):
        if not isinstance(value, list):
            yield f"{where} is no array"
            return
        for i, item in enumerate(value):
            yield from problems(item, shape[0], f"{where}[{i}]")
    elif not shape(value):
        yield f"{where} isn't as it must be: {value!r:.80}"


def depth(value: object) -> int:
    """How many objects and arrays lie within each other."""
    deepest, todo = 0, [(value, 1)]
    while todo:
        v, at = todo.pop()
        if isinstance(v, (dict, list)):
            deepest = max(deepest, at)
            todo += [(x, at + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return deepest


# names, values and ranges are those of the wire contract; fixed values
_STAMP = like(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)")
_OPTIONS = Shape({"includePatterns": [text], "excludePatterns": [text], "includeGeneratedCode": flag, "includeChunkText": flag, "syntaxOnly": flag, "noRestore": flag, "isolateInput": flag, "top": whole(0)})
_INPUT = Shape({"kind": among("directory", "project", "solution"), "sourcePopulationSha256": like("sha256:[0-9a-f]{64}"), "options": _OPTIONS}, {"selectedPath": text})
_ARTIFACTS = Shape({k: among(v) for k, v in {"summary": "summary.json", "metrics": "metrics.ndjson", "graph": "graph.json", "chunks": "chunks.ndjson", "diagnostics": "diagnostics.ndjson"}.items()})
MANIFEST = Shape({
    "schemaVersion": among(CONTRACT_VERSION), "tool": text, "toolVersion": text, "rootPath": text, "startedAt": _STAMP, "completedAt": _STAMP, "durationMs": whole(0), "mode": among("syntax", "semantic", "partial_semantic"), "input": _INPUT, "artifacts": _ARTIFACTS,
})
_HEALTH = Shape({
    "analysisQuality": among("trusted", "degraded", "syntax_only"), "semanticModel": among("msbuild", "not_available", "none"), "restoreStatus": among("not_run", "success", "failed"), "buildStatus": among("not_run", "success", "failed"),
    "trustedDiagnostics": flag, "diagnosticsIncludedInHotspotRank": flag, "messages": [text],
})
_COMPONENT = Shape({"metricId": text, "value": number, "percentile": share, "weight": share})
_HOTSPOT = Shape(
    {"targetId": text, "targetKind": among("solution", "project", "file", "type", "member"), "targetName": text, "rank": whole(1), "rankScore": share, "filePath": text, "startLine": whole(1), "endLine": whole(1), "reasons": lambda v: isinstance(v, list) and len(v) > 0 and all(map(text, v))},
    {"components": [_COMPONENT]},
)
_COUNTS = ("projectCount", "fileCount", "typeCount", "memberCount", "metricResultCount", "diagnosticCount")
SUMMARY = Shape({"schemaVersion": among(CONTRACT_VERSION), "rootPath": text, **{c: whole(0) for c in _COUNTS}, "analysisHealth": _HEALTH, "hotspots": [_HOTSPOT]})


def manifest_problems(document: object) -> Iterator[str]:
    yield from problems(document, MANIFEST, "manifest")
    chosen = document.get("input") if isinstance(document, dict) else None
    if isinstance(chosen, dict) and chosen.get("kind") in ("project", "solution") and "selectedPath" not in chosen:
        yield "manifest.input lacks selectedPath"
