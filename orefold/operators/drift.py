"""Schemas that drift between the files of a feed."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orefold.runtime import materialize, small_side

LEAVES_SCHEMA = "ok boolean, rec string, leaves map<string,struct<t:string,v:string>>"


def _reject(name: str) -> None:
    raise ValueError(name)


def _flatten(node: dict, prefix: str, out: dict) -> None:
    """Leaf paths of an object with JSON type and canonical text; nulls are absent, an array is one leaf."""
    stack = [(prefix, node)]
    while stack:
        at, obj = stack.pop()
        for name, value in obj.items():
            path = at + name
            if isinstance(value, dict):
                stack.append((path + ".", value))
            elif isinstance(value, str):
                out[path] = ("string", value)
            elif isinstance(value, bool):
                out[path] = ("boolean", "true" if value else "false")
            elif isinstance(value, (int, float)):
                out[path] = ("number", repr(value))
            elif isinstance(value, list):
                out[path] = ("array", json.dumps(value, sort_keys=True, ensure_ascii=False))


def parse_line(payload: str | None, record_keys: Sequence[str]) -> tuple[bool, str | None, dict]:
    """Whether the line parses as a JSON object, the record's key (null if it has none of the keys), and its leaves."""
    obj = _object(payload)
    if obj is None:
        return False, None, {}
    out: dict = {}
    _flatten(obj, "", out)
    key = [out.get(k, (None, None))[1] for k in record_keys]
    return True, json.dumps(key, ensure_ascii=False) if any(k is not None for k in key) else None, out


def load_leaves(lines: DataFrame, record_keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """Each line with `ok`, its record key `rec` and `leaves`, a map from property path to raw type and text.

    Broken, null and non-object lines come out with ok = false and no leaves. All other columns stay.
    A line in which one property occurs twice has the last value. JSON numbers keep their shortest text.
    """
    kept = [c for c in lines.columns if c not in ("ok", "rec", "leaves")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema if f.name in kept) + ", " + LEAVES_SCHEMA
    keys = list(record_keys)
    item = pa.struct([("t", pa.string()), ("v", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, recs, offsets, paths, kinds, values = [], [], [0], [], [], []
            for line in batch.column(batch.schema.get_field_index(payload)).to_pylist():
                parsed, rec, leaves = parse_line(line, keys)
                ok.append(parsed)
                recs.append(rec)
                for path, (kind, value) in leaves.items():
                    paths.append(path)
                    kinds.append(kind)
                    values.append(value)
                offsets.append(len(paths))
            cells = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], fields=list(item))
            maps = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(paths, pa.string()), cells)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_()), pa.array(recs, pa.string()), maps], names=[*kept, "ok", "rec", "leaves"])

    return lines.select(*kept).mapInArrow(read, schema)


def _kinds(node: dict, prefix: str, out: dict) -> None:
    """Leaf paths of an object with the bit of their JSON type."""
    stack = [(prefix, node)]
    while stack:
        at, obj = stack.pop()
        for name, value in obj.items():
            if isinstance(value, dict):
                stack.append((at + name + ".", value))
            elif value is not None:
                out[at + name] = 1 if isinstance(value, str) else 4 if isinstance(value, bool) else 8 if isinstance(value, list) else 2


def _object(payload: str | None) -> dict | None:
    """The object of a line; None for broken, null and non-object lines."""
    try:
        obj = json.loads(payload, parse_constant=_reject) if payload is not None else None
    except (ValueError, RecursionError):
        return None
    return obj if isinstance(obj, dict) else None


def field_stats(lines: DataFrame, file_keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """Path-type statistics by file: `kinds`, the JSON types of each path as a set of bits (1 string, 2 number, 4 boolean, 8 array), and `n_lines` that hold it.

    Lines are parsed and counted where they are read, so only a few rows per file go on. A file has one row with a null path besides, so that files without a line that
    parses are known too.
    """
    names = list(file_keys)
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, dict] = {}
            keys = zip(*(batch.column(i).to_pylist() for i in range(len(names))))
            for key, line in zip(keys, batch.column(len(names)).to_pylist()):
                own = found.setdefault(key, {None: [0, 0]})
                obj = _object(line)
                if obj is not None:
                    here: dict = {}
                    _kinds(obj, "", here)
                    for path, bit in here.items():
                        cell = own.setdefault(path, [0, 0])
                        cell[0] |= bit
                        cell[1] += 1
            flat = [(key, path, *cell) for key, own in found.items() for path, cell in own.items()]
            columns = [pa.array([f[0][i] for f in flat], batch.schema.field(i).type) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[1] for f in flat], pa.string()), pa.array([f[2] for f in flat], pa.int32()), pa.array([f[3] for f in flat], pa.int64())], names=[*names, "path", "kinds", "n_lines"])

    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", path string, kinds int, n_lines bigint"
    partial = lines.select(*names, payload).mapInArrow(count, ddl)
    return partial.repartition(*names).groupBy(*names, "path").agg(F.bit_or("kinds").alias("kinds"), F.sum("n_lines").alias("n_lines"))


def field_values(lines: DataFrame, record_keys: Sequence[str], keep: Sequence[str], paths: str, payload: str = "payload", whole: str | None = None) -> DataFrame:
    """The columns `keep` with rec, path and v (type and text) for each of the line's own `paths` (array<string>) that it holds.

    rec is the text of the record's keys. Lines without any of them are no record that could be met again and are left out, but for those where
    the boolean column `whole` says that a line is its file's only record.
    """
    names, keys = list(keep), list(record_keys)
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, recs, found, values = [], [], [], []
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: E731, B023
            for i, (line, wanted, one) in enumerate(zip(column("__line"), column("__paths"), column("__whole"))):
                obj = _object(line)
                if obj is None:
                    continue
                leaves: dict = {}
                _flatten(obj, "", leaves)
                key = [leaves.get(k, (None, None))[1] for k in keys]
                if not one and not any(k is not None for k in key):
                    continue
                rec = "" if one else json.dumps(key, ensure_ascii=False)
                for path in wanted:
                    if path in leaves:
                        at.append(i)
                        recs.append(rec)
                        found.append(path)
                        values.append(":".join(leaves[path]))
            kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(at, pa.int32())) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(recs, pa.string()), pa.array(found, pa.string()), pa.array(values, pa.string())], names=[*names, "rec", "path", "v"])

    one = F.coalesce(F.col(whole), F.lit(False)) if whole else F.lit(False)
    read_from = lines.select(*names, F.col(payload).alias("__line"), F.col(paths).alias("__paths"), one.alias("__whole"))
    return read_from.mapInArrow(read, ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", rec string, path string, v string")


def _match(shares: DataFrame, by: Sequence[str]) -> DataFrame:
    """by with `renames`, the pairs of fields, best first, each field at most once; the pairs of a file are bounded by the fields of two files."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("a"), (-F.col("same")).alias("b"), "field_before", "field_after")))
    taken = lambda acc, x: F.exists(acc, lambda k: (k["field_before"] == x["field_before"]) | (k["field_after"] == x["field_after"]))
    keep = F.aggregate(
        "best", F.array().cast("array<struct<field_before:string,field_after:string>>"),
        lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.array_append(acc, F.struct(x["field_before"].alias("field_before"), x["field_after"].alias("field_after")))),
    )
    return shares.groupBy(*by).agg(best.alias("best")).select(*by, keep.alias("renames"))


def schema_changes(lines: DataFrame, record_keys: Sequence[str], payload: str = "payload", feed: str = "feed", seq: str = "file_seq", whole: str | None = None) -> DataFrame:
    """Fields added, removed, retyped or renamed between a file and the one before it in its feed.

    A rename pairs one field only in the earlier with one only in the later file of which more than half of the common
    records that have both hold the same value (type and text); each field is paired at most once, best share first,
    then most equal records, then by name. A record that occurs more than once in a file counts with each of its values and is equal if one of them is; lines without
    any key are no records (see field_values for `whole`). Feeds and files of null number are left out; files without a line that parses have no fields.

    Statistics per file decide what is added, removed and retyped; lines are read again only of files that have both added and removed fields, and only these fields of them.
    Columns: feed, seq, change, field_before, field_after.
    """
    there = lines.where(F.col(feed).isNotNull() & F.col(seq).isNotNull())
    per_file = field_stats(there, [feed, seq], payload).groupBy(feed, seq).agg(F.map_from_entries(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "kinds")))).alias("now"))
    order = Window.partitionBy(feed).orderBy(seq)
    compared = per_file.select(feed, F.col(seq).alias("pair"), "now", F.lag("now").over(order).alias("old"), F.lag(seq).over(order).alias("__before")).where("old IS NOT NULL")
    names = F.map_keys
    changed = compared.select(
        feed, "pair", "__before", F.array_except(names("now"), names("old")).alias("added"), F.array_except(names("old"), names("now")).alias("removed"),
        F.filter(names("now"), lambda k: F.try_element_at("old", k) != F.try_element_at("now", k)).alias("retyped"),
    ).where("size(added) + size(removed) + size(retyped) > 0")
    changed = materialize(changed, "changes")  # at most a row per file

    # records of the two files, only for fields that are on one side and only where both kinds of them exist
    mixed = changed.where("size(added) > 0 AND size(removed) > 0")
    side = lambda n, at, paths: F.struct(F.col(at).alias(seq), F.lit(n).alias("side"), F.col(paths).alias("paths"))
    wanted = mixed.select(feed, "pair", F.inline(F.array(side(0, "__before", "removed"), side(1, "pair", "added"))))
    wanted, _ = small_side(wanted)
    held = field_values(there.join(wanted, [feed, seq]), record_keys, [feed, "pair", "side"], "paths", payload, whole)
    on = lambda n: F.collect_set(F.when(F.col("side") == n, F.col("path")))
    alike = held.groupBy(feed, "pair", "rec", "v").agg(on(0).alias("x"), on(1).alias("y"))
    # per record the fields of either side and which of them share a value; no list here is longer than the fields of a file allow
    fields = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    records = alike.groupBy(feed, "pair", "rec").agg(fields("x").alias("xs"), fields("y").alias("ys"), F.collect_set(F.when((F.size("x") > 0) & (F.size("y") > 0), F.struct("x", "y"))).alias("hits"))
    each = records.select(feed, "pair", "hits", F.explode("xs").alias("field_before"), "ys").select(feed, "pair", "hits", "field_before", F.explode("ys").alias("field_after"))
    same = F.exists("hits", lambda h: F.array_contains(h["x"], F.col("field_before")) & F.array_contains(h["y"], F.col("field_after"))).cast("int")
    shares = each.groupBy(feed, "pair", "field_before", "field_after").agg(F.avg(same).alias("share"), F.sum(same).alias("same")).where("share > 0.5")
    renamed = _match(shares, [feed, "pair"])

    out = changed.join(renamed, [feed, "pair"], "left").withColumn("renames", F.coalesce("renames", F.array().cast("array<struct<field_before:string,field_after:string>>")))
    row = lambda change, before, after: F.struct(F.lit(change).alias("change"), before.alias("field_before"), after.alias("field_after"))
    none = F.lit("")
    every = F.concat(
        F.transform(F.array_except("added", "renames.field_after"), lambda p: row("added", none, p)), F.transform(F.array_except("removed", "renames.field_before"), lambda p: row("removed", p, none)),
        F.transform("retyped", lambda p: row("retyped", p, p)), F.transform("renames", lambda r: row("renamed", r["field_before"], r["field_after"])),
    )
    return out.select(feed, F.col("pair").alias(seq), F.inline(every))


def spellings(columns: Sequence[str], *evidence: Sequence[tuple[str, str, int]]) -> dict[str, list[str]]:
    """Other spellings of each column, from renames (one name, other name, weight); earlier lists of evidence go before later ones.

    Names that renames connect are one field, whatever their direction. The heaviest renames connect first, and one that would
    make two columns the same field is passed over. Spellings nearest in that order come first; fields without a column have no entry.
    """
    root: dict[str, str] = {}
    members: dict[str, list[str]] = {}

    def find(x: str) -> str:
        if x not in root:
            root[x], members[x] = x, [x]
        while root[x] != x:
            x = root[x]
        return x

    for c in columns:
        find(c)
    for renames in evidence:
        for a, b, _ in sorted(renames, key=lambda r: (-r[2], r[0], r[1])):
            x, y = find(a), find(b)
            if x == y or (x in columns and y in columns):
                continue
            x, y = (y, x) if y in columns or (x not in columns and y < x) else (x, y)
            root[y] = x  # a column stays the root of its field
            members[x] += members.pop(y)
    return {c: members[c][1:] for c in columns if len(members[c]) > 1}


def feed_spellings(lines: DataFrame, changes: DataFrame, columns: Sequence[str], feed: str = "feed") -> DataFrame:
    """For each feed of lines the `names` its columns go by: those of its own renames in changes first, then those of all these feeds.

    A feed may have had a spelling from its first file on, or changed name and type at once, so that only other feeds tell the rename.
    The distinct pairs of names are collected; field names are few, however many the files.
    """
    feeds = lines.select(feed).distinct()
    renames = changes.where("change = 'renamed'").join(feeds, feed, "left_semi").groupBy(feed, "field_before", "field_after").agg(F.count("*").alias("n"))
    renames = materialize(renames, "renames")
    everywhere = [tuple(r) for r in renames.groupBy("field_before", "field_after").agg(F.sum("n")).collect()]
    wanted = list(columns)
    solve = F.udf(lambda own: spellings(wanted, [(r.a, r.b, r.n) for r in own or []], everywhere), "map<string,array<string>>")
    own = renames.groupBy(feed).agg(F.collect_list(F.struct(F.col("field_before").alias("a"), F.col("field_after").alias("b"), "n")).alias("own"))
    return feeds.join(own, feed, "left").select(feed, solve("own").alias("names"))


def project_typed(leaves: DataFrame, columns: Mapping[str, str], aliases: Mapping[str, Sequence[str]] | str, file_keys: Sequence[str]) -> DataFrame:
    """One consistent table: a typed column per canonical field, from the field itself or the first alias that is present.

    aliases is one mapping for all lines or the name of a column that holds it (map<string,array<string>>).
    Casts that fail leave null and name the field in `failed_casts`; fields that no column took stay in `extra`
    as a map of raw texts. Lines that don't parse are left out (load_leaves reports them).
    """
    if isinstance(aliases, str):
        others = lambda c: F.coalesce(F.try_element_at(aliases, F.lit(c)), F.array().cast("array<string>"))
    else:
        others = lambda c: F.array(*[F.lit(p) for p in aliases.get(c, ())]).cast("array<string>")
    first = lambda c: F.filter(F.concat(F.array(F.lit(c)), others(c)), lambda p: F.map_contains_key("leaves", p))
    found = leaves.where("ok").select(*file_keys, "leaves", F.array(*[F.try_element_at(first(c), F.lit(1)) for c in columns]).alias("__taken"))
    leaf = {c: F.try_element_at("leaves", F.col("__taken")[i]) for i, c in enumerate(columns)}
    cast = {}
    for c, kind in columns.items():
        text = leaf[c]["v"]
        cast[c] = F.from_json(text, "array<string>") if kind == "array<string>" else text.try_cast(kind)
    failed = F.array_compact(F.array(*[F.when(leaf[c]["v"].isNotNull() & cast[c].isNull(), F.lit(c)) for c in columns]))
    taken = F.array_compact("__taken")
    extra = F.transform_values(F.map_filter("leaves", lambda k, _: ~F.array_contains(taken, k)), lambda _, v: v["v"])
    return found.select(*file_keys, *[cast[c].alias(c.replace(".", "_")) for c in columns], failed.alias("failed_casts"), extra.alias("extra"))
