"""Repeated token windows, without enumerating pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.operators.intervals import covered, merged_islands
from orefold.operators.relational import global_rank

#: The reference thresholds: tokens of a window, and lines it must span.
MIN_TOKENS, MIN_LINES = 100, 10

_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

Tokens = tuple[Sequence[str], Sequence[int], Sequence[int]]


def word_tokens(text: str) -> Tokens:
    """Words between white space, with the lines they start and end on."""
    words, at = [], []
    for n, line in enumerate(text.split("\n"), 1):
        found = line.split()
        words += found
        at += [n] * len(found)
    return words, at, at


def _rolling(values: np.ndarray, size: int, by: np.uint64) -> np.ndarray:
    """Hashes of all windows of `size` values by doubling: a hash of 2k is made of two of k."""
    out: np.ndarray | None = None
    done, span, level = 0, 1, values
    with np.errstate(over="ignore"):
        while done < size:
            if size & span:
                part = level[done:] if out is not None else level
                out = level if out is None else (out[: len(part)] * by + part[: len(out)]) * by
                done += span
            span *= 2
            if done < size:
                half = span // 2
                shifted = level[half:]
                level = (level[: len(shifted)] ^ np.uint64(span)) * by + shifted * (by ^ np.uint64(span))
                level ^= level >> np.uint64(29)
    return out[: max(0, len(values) - size + 1)]


def token_windows(sources: DataFrame, file: str, text: str, tokenize: Callable[[str], Tokens], min_tokens: int = MIN_TOKENS, min_lines: int = MIN_LINES) -> DataFrame:
    """One row per window of min_tokens tokens that spans min_lines lines: file, pos, start_line, end_line and a 128-bit key.

    Windows are hashed where the text is read; only their keys and positions are shuffled later.
    """
    kind = sources.schema[file].dataType.simpleString()
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not body:
                    continue
                words, first, last = tokenize(body)
                if len(words) < min_tokens:
                    continue
                start, end = np.asarray(first[: len(words) - min_tokens + 1], np.int32), np.asarray(last[min_tokens - 1 :], np.int32)
                keep = np.flatnonzero(end - start + 1 >= min_lines)
                if not len(keep):
                    continue
                hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
                k1, k2 = (_rolling(hashed, min_tokens, by)[keep].view(np.int64) for by in _MULTIPLIERS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keep), types[kind]), pa.array(keep.astype(np.int32)), pa.array(start[keep]), pa.array(end[keep]), pa.array(k1), pa.array(k2)],
                    names=["file", "pos", "start_line", "end_line", "k1", "k2"],
                )

    return sources.select(F.col(file), F.col(text)).mapInArrow(run, f"file {kind}, pos int, start_line int, end_line int, k1 bigint, k2 bigint")


def repeated_windows(windows: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Windows whose key occurs in another file, or in the same one at a distance of min_tokens or more.

    The extremes of file and position per key decide; they combine before the shuffle, so a key with very many occurrences is no hot
    group, and the keys that repeat are joined back as distinct rows. Texts are hashed twice for it: writing a row per token costs more than that.
    """
    per_key = windows.groupBy("k1", "k2").agg(F.min("file").alias("f0"), F.max("file").alias("f1"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    several = per_key.where((F.col("f0") != F.col("f1")) | (F.col("p1") - F.col("p0") >= min_tokens))
    back = windows.join(several, ["k1", "k2"])
    return back.where((F.col("f0") != F.col("f1")) | (F.col("pos") - F.col("p0") >= min_tokens) | (F.col("p1") - F.col("pos") >= min_tokens)).select("file", "pos", "start_line", "end_line", (F.col("f0") != F.col("f1")).alias("across_files"))


def duplicated_regions(repeated: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Overlapping windows of a file merged: file, start and end (token positions, end exclusive), start_line, end_line."""
    spans = repeated.select("file", F.col("pos").alias("start"), (F.col("pos") + min_tokens).alias("end"), "start_line", "end_line")
    islands = merged_islands(spans.select("file", "start", "end"), ["file"], False)
    firsts = spans.select("file", "start", "start_line").distinct()
    lasts = spans.select("file", "end", "end_line").distinct()
    return islands.join(firsts, ["file", "start"]).join(lasts, ["file", "end"]).select("file", "start", "end", "start_line", "end_line")


def duplicated_lines(regions: DataFrame) -> DataFrame:
    """Lines of each file that lie in some region, each once."""
    return covered(regions, ["file"], "start_line", "end_line").withColumnRenamed("covered", "duplicated_line_count")


def with_tags(regions: DataFrame) -> DataFrame:
    """Regions with their tag duplication_block:NNNNNN in the order of file and start."""
    ranked = global_rank(regions, [F.col("file"), F.col("start")], "__n")
    return ranked.withColumn("tag", F.format_string("duplication_block:%06d", F.col("__n"))).drop("__n")
