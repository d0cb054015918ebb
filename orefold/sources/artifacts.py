"""Readers of published artifacts, with fixed schemas and limits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold import schemas
from orefold.plans.contracts import MAX_DEPTH, depth
from orefold.plans.reporting import _WIRE, camel

#: Limits of one artifact. Fixed values.
MAX_JSON, MAX_NDJSON, MAX_LINE, MAX_LINES = 128 << 20, 1 << 30, 8 << 20, 1_000_000


def _wire_type(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(_WIRE.get(f.name, camel(f.name)), _wire_type(f.dataType)) for f in t])
    return T.ArrayType(_wire_type(t.elementType)) if isinstance(t, T.ArrayType) else t


def _parse_ddl(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def check_size(spark: SparkSession, path: str, most: int) -> None:
    """An error if any file of path is longer than the limit; only lengths are read."""
    longest = spark.read.format("binaryFile").load(path).select("length").agg(F.max("length").alias("n")).first().n
    if (longest or 0) > most:
        raise ValueError(f"{path} has a file of {longest} bytes; the limit is {most}")


def check_lines(spark: SparkSession, path: str) -> None:
    """An error if an NDJSON artifact has more bytes, characters in a line, or lines than the contract allows; one pass that keeps no text."""
    check_size(spark, path, MAX_NDJSON)
    seen = spark.read.text(path).agg(F.count("*").alias("lines"), F.coalesce(F.max(F.length("value")), F.lit(0)).alias("longest")).first()
    if seen.lines > MAX_LINES or seen.longest > MAX_LINE:
        raise ValueError(f"{path} has {seen.lines} lines of up to {seen.longest} characters; the limits are {MAX_LINES} and {MAX_LINE}")


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file, to tell whether a snapshot stayed as it was between two reads."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_ndjson(spark: SparkSession, path: str, ddl: str, strict: bool = True) -> DataFrame:
    """Rows of an NDJSON artifact under our names; with strict, a line that doesn't fit is an error. Blank lines are skipped."""
    check_lines(spark, path)
    own = _parse_ddl(ddl)
    rows = spark.read.schema(_wire_type(own)).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return rows.select(*[F.col(_WIRE.get(f.name, camel(f.name))).cast(f.dataType).alias(f.name) for f in own])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with file and line number, for reports that name lines; line feeds of either style end a line."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r\n|\n").alias("l"))
    return whole.select("file", F.posexplode("l").alias("n", "value")).where("trim(value) <> ''").select("file", (F.col("n") + 1).alias("line_no"), "value")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return read_ndjson(spark, path, schemas.METRICS)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_ndjson(spark, path, schemas.CHUNKS)


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    return read_ndjson(spark, path, f"schema_version string, {schemas.DIAGNOSTICS}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph document."""
    check_size(spark, path, MAX_JSON)
    schema = f"schemaVersion string, nodes array<{_wire_type(_parse_ddl(schemas.NODES)).simpleString()}>, edges array<struct<`from`:string,`to`:string,kind:string,confidence:string>>"
    doc = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    nodes = doc.select(F.inline("nodes"))
    own = _parse_ddl(schemas.NODES)
    named = nodes.select(*[F.col(camel(f.name)).cast(f.dataType).alias(f.name) for f in own])
    edges = doc.select(F.inline("edges")).select(F.col("from").alias("from_id"), F.col("to").alias("to_id"), "kind", "confidence")
    return named, edges


def read_document(spark: SparkSession, path: str) -> dict:
    """A small JSON document (manifest or summary); one that nests too deep is an error."""
    check_size(spark, path, MAX_JSON)
    document = json.loads(spark.read.text(path, wholetext=True).first().value)
    if depth(document) > MAX_DEPTH:
        raise ValueError(f"{path} nests deeper than {MAX_DEPTH}")
    return document
