"""Column functions: identities, paths, globs, text measures and number checks."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

SOLUTION_ID = "solution:root"


# identities


def project_key(path: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the project path."""
    return F.left(F.sha2(path, 256), F.lit(16))


def project_id(path: Column) -> Column:
    return F.concat(F.lit("project:"), project_key(path))


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def namespace_id(key: Column, name: Column) -> Column:
    return F.concat(F.lit("namespace:"), key, F.lit("/N:"), F.when(F.coalesce(name, F.lit("")) == "", "(global)").otherwise(name))


def fallback_type_id(key: Column, qualified: Column, path: Column) -> Column:
    return F.concat(F.lit("type:"), key, F.lit("/"), qualified, F.lit("@"), path)


def fallback_member_id(key: Column, owner: Column, name: Column, parameters: Column, path: Column, line: Column) -> Column:
    return F.concat(F.lit("member:"), key, F.lit("/"), owner, F.lit("."), name, F.lit("#"), parameters.cast("string"), F.lit("@"), path, F.lit(":"), line.cast("string"))


def chunk_id(target: Column, kind: Column, path: Column, line: Column, column: Column) -> Column:
    return F.concat(F.lit("chunk:"), target, F.lit("#"), kind, F.lit("@"), path, F.lit(":"), line.cast("string"), F.lit(":"), column.cast("string"))


def is_three_part_version(version: Column) -> Column:
    return version.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")


# paths


def normal_path(path: Column) -> Column:
    """Backslashes as slashes, without a leading ./"""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def directory(path: Column) -> Column:
    """The part before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def within(path: Column, root: str) -> Column:
    """Whether a normal path is the root or lies below it, component by component."""
    base = root.rstrip("/")
    return (path == base) | path.startswith(base + "/") if base else ~path.startswith("/") & ~path.rlike(r"^\.\.(/|$)")


_GENERATED = (".g.cs", ".generated.cs", ".designer.cs")


def is_generated(path: Column) -> Column:
    """Generated C# files by name, ignoring case."""
    name = F.lower(file_name(path))
    hit = name == "assemblyinfo.cs"
    for suffix in _GENERATED:
        hit = hit | name.endswith(suffix)
    return hit


def in_excluded_directory(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(\.git|\.vs|bin|obj|artifacts)/")


# globs


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: **/ any directories or none, ** anything, * within a name, ? one character of a name."""
    text = re.sub(r"^(\./)+", "", pattern.replace("\\", "/"))
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(p, re.escape(p)) for p in re.split(r"(\*\*/|\*\*|\*|\?)", text) if p) + "$"


def _any_glob(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def glob_filter(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Paths that some include matches (all, without includes) and no exclude does."""
    path = normal_path(path)
    return (_any_glob(path, include) if include else F.lit(True)) & ~_any_glob(path, exclude)


def paths_selected(paths: Column, include: list[str], exclude: list[str]) -> Column:
    """For an array of paths: every one matches some include, and none an exclude."""
    ok = F.forall(paths, lambda p: _any_glob(normal_path(p), include)) if include else F.lit(True)
    return ok & ~F.exists(paths, lambda p: _any_glob(normal_path(p), exclude))


# text


def is_blank(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*$")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up; 0 for empty text."""
    return F.ceil(utf16_length(text) / F.lit(4.0)).cast("int")


def split_lines(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n", -1)


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last of a text (from 1, clamped to it), joined by line feeds."""
    lines = split_lines(text)
    n = F.size(lines)
    a = F.greatest(F.lit(1), F.least(first, n))
    b = F.greatest(a, F.least(last, n))
    return F.array_join(F.slice(lines, a, b - a + 1), "\n")


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


# numbers


def is_finite(x: Column) -> Column:
    return F.abs(x) < float("inf")


def is_integral(x: Column) -> Column:
    return is_finite(x) & (x % 1 == 0)


def round_half_up(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def hinge(value: Column, limit: Column, weight: Column) -> Column:
    return F.greatest(F.lit(0.0), value - limit) * weight


def short_number(x: Column, digits: int = 2) -> Column:
    """Rounded to some digits, without trailing zeros."""
    text = F.format_string(f"%.{digits}f", F.round(x, digits))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def is_mathematical_integer(raw: str) -> bool:
    """Whether the text of a JSON number is an integer, whatever its length or exponent."""
    try:
        value = Decimal(raw)
    except InvalidOperation:
        return False
    if not value.is_finite():
        return False
    _, digits, exponent = value.normalize().as_tuple()
    return digits == (0,) or exponent >= 0


def duration_ms(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.unix_millis(end) - F.unix_millis(start))


# diagnostics


def diagnostic_tags(diagnostic: Column) -> Column:
    """compiler or analyzer by prefix, and nullable for the nullable warnings of the compiler."""
    return F.array_compact(
        F.array(
            F.when(diagnostic.startswith("CS"), "compiler").otherwise("analyzer"),
            F.when(diagnostic.rlike(r"^CS8[678]"), "nullable"),
        )
    )
