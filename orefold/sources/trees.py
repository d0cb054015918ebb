"""Source trees: what is selected, which files are read, and which project they belong to."""

from __future__ import annotations

import os
import re
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions import scalar as fn

#: Limits of one input tree. Fixed values.
MAX_TOTAL, MAX_FILE, MAX_FILES, MAX_DIRS, MAX_DEPTH = 4 << 30, 256 << 20, 250_000, 50_000, 96
EXCLUDED = frozenset((".git", ".vs", "bin", "obj", "artifacts"))
BOUNDARY = (".git", "global.json", "Directory.Build.props")
AMBIENT = ("Directory.Build.props", "Directory.Build.targets", "Directory.Packages.props", "global.json", "NuGet.config")

_PROJECT_LINE = re.compile(r'^\s*Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+\.csproj)"', re.IGNORECASE)


def select_input(path: str) -> tuple[str, Path, list[Path]]:
    """(kind, root, projects) of a directory, a .csproj or a .sln; anything else is an error."""
    p = Path(path).resolve()
    if p.is_dir():
        return "directory", p, []
    if p.is_file() and p.suffix.lower() == ".csproj":
        return "project", p.parent, [p]
    if p.is_file() and p.suffix.lower() == ".sln":
        projects = [q for q in solution_projects(p) if q.is_file()]
        return "solution", common_root(p.parent, projects), projects
    raise ValueError(f"{path} is no directory, project or solution")


def solution_projects(path: Path) -> list[Path]:
    """Project files a solution names, in its order."""
    lines = path.read_text(encoding="utf-8-sig").splitlines()
    return [(path.parent / m[1].replace("\\", "/")).resolve() for line in lines if (m := _PROJECT_LINE.match(line))]


def common_root(start: Path, projects: list[Path]) -> Path:
    """The lowest directory above the solution and all its projects, not above a repository boundary."""
    limit = next((d for d in (start, *start.parents) if any((d / b).exists() for b in BOUNDARY)), None)
    for d in (start, *start.parents):
        if all(q.is_relative_to(d) for q in projects):
            return d
        if d == limit:
            break
    return start


def ambient_files(root: Path) -> list[Path]:
    """Build files in the directories above the root, which may change what a build would see."""
    return [d / n for d in root.resolve().parents for n in AMBIENT if (d / n).is_file()]


def links(root: Path) -> list[str]:
    """Relative paths of the links in a tree, whose excluded directories aren't entered."""
    found = []
    for folder, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if d.lower() not in EXCLUDED]
        found += [Path(folder, n).relative_to(root).as_posix() for n in (*dirs, *files) if Path(folder, n).is_symlink()]
    return found


def scan(spark: SparkSession, root: str, pattern: str = "*.cs", include: list[str] | None = None, exclude: list[str] | None = None, generated: bool = False) -> DataFrame:
    """Files of a tree by relative path: file_path, length and content, without excluded directories, and without generated files unless asked for.

    Links of a local tree, to files or directories, aren't followed. Only paths and lengths are read for the limits; a tree beyond them is an error, never cut.
    """
    local = "://" not in root
    base = str(Path(root).resolve()) if local else root.rstrip("/")
    uri = Path(base).as_uri() if local else base
    linked = links(Path(base)) if local else []
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(uri)
    relative = F.url_decode(F.replace(F.substring(F.regexp_replace("path", r"^file:/+", "/") if local else F.col("path"), len(base) + 2, 1 << 20), F.lit("+"), F.lit("%2B")))
    files = raw.withColumn("file_path", relative)
    keep = ~fn.in_excluded_directory(F.col("file_path")) & fn.glob_filter(F.col("file_path"), include or [], exclude or [])
    if linked:  # driver's own listing of the tree, which has few links
        keep = keep & ~F.exists(F.array(*map(F.lit, linked)), lambda p: (F.col("file_path") == p) | F.startswith(F.col("file_path"), F.concat(p, F.lit("/"))))
    files = files.where(keep if generated else keep & ~fn.is_generated(F.col("file_path")))
    n = files.select("file_path", "length").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"), F.coalesce(F.max("length"), F.lit(0)).alias("largest"), F.count_distinct(fn.directory(F.col("file_path"))).alias("dirs"),
        F.coalesce(F.max(F.size(F.split("file_path", "/"))), F.lit(0)).alias("depth"),
    ).first()
    if n.files > MAX_FILES or n.total > MAX_TOTAL or n.largest > MAX_FILE or n.dirs > MAX_DIRS or n.depth > MAX_DEPTH:
        raise ValueError(f"the tree exceeds the limits: {n.asDict()}")
    return files.select("file_path", "length", "content")


def text_of(content: Column) -> Column:
    """Text of a file's bytes: UTF-16 by its byte order mark, else UTF-8 with invalid bytes replaced; marks are left out."""
    head = F.hex(F.substring(content, 1, 2))
    utf8 = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(utf8), "^\ufeff", "")


def read_sources(spark: SparkSession, root: str, **options) -> DataFrame:
    """file_path and text of the C# files of a tree, without byte order marks."""
    files = scan(spark, root, "*.cs", **options)
    return files.select("file_path", text_of(F.col("content")).alias("text"))


def read_projects(spark: SparkSession, root: str) -> DataFrame:
    """Relative paths of the project files of a tree."""
    return scan(spark, root, "*.csproj", generated=True).select(F.col("file_path").alias("project_path"))


def read_project_references(spark: SparkSession, root: str) -> DataFrame:
    """from_project_path and to_project_path of the ProjectReference items of a tree's project files."""
    files = scan(spark, root, "*.csproj", generated=True).select("file_path", text_of(F.col("content")).alias("xml"))
    found = files.select("file_path", F.explode(F.regexp_extract_all("xml", F.lit(r'<ProjectReference\s[^>]*Include\s*=\s*"([^"]+)"'), F.lit(1))).alias("target"))
    joined = F.concat_ws("/", F.nullif(fn.directory(F.col("file_path")), F.lit("")), fn.normal_path(F.col("target")))
    folded = F.aggregate(
        F.filter(F.split(joined, "/"), lambda p: ~p.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return found.select(F.col("file_path").alias("from_project_path"), F.array_join(folded, "/").alias("to_project_path"))


def in_scope(files: DataFrame, selected: DataFrame) -> DataFrame:
    """Files (with project_path) whose nearest project is among the selected ones."""
    return files.join(selected.select("project_path").distinct(), "project_path", "left_semi")


def isolated_copy(root: str, target: str) -> str:
    """A private copy of the tree without excluded directories and links."""

    def skip(folder: str, names: list[str]) -> set[str]:
        return {n for n in names if n.lower() in EXCLUDED or (Path(folder) / n).is_symlink()}

    return shutil.copytree(root, target, ignore=skip)
