"""Reading JSON lines whose fields drift from file to file.

``ingest`` enforces a target schema: a value of a target column's own kind
becomes a typed value, everything unknown or of another kind is preserved as
JSON in ``_rescued``; ``_seen`` tells of every field of the line where it went,
its kind and its value's digest. ``replay`` promotes fields: rescued values are
read into typed columns, also into new ones and from approved other names,
without going back to the files. ``changes`` compares each file with the one
before of its series and reports every field that was added, removed, renamed
or changed its type, from what ``ingest`` has seen.

Lines are read in Arrow batches: a line's fields differ, so every expression on
VARIANT is evaluated field by field; that took some 90 microseconds a line, the
reader here takes about 20. All that follows is joins and aggregates on rows
per field, so neither files, names nor records of a series gather anywhere.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators.joins import asof
from ionloom.session import stored

# Bit of each kind of value; null has none.
KINDS = {"text": 1, "number": 2, "flag": 4, "list": 8, "object": 16}
#: Columns that ingest adds to the target's.
ADDED = ("_rescued", "_seen", "_reason")
_SEEN = "array<struct<name:string,place:string,kind:int,digest:bigint>>"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
_ENDLESS = (math.inf, -math.inf)
_LONE = re.compile(r"(?<!\\)(?:\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2})")
_WHOLE = {"bigint": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1)}


def _refuse(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def read_line(text: str | None) -> tuple[dict | None, str | None]:
    """(fields, reason). reason: why a line is not read, or "repeated field" where the last of several of one name counts."""
    if text is None or not text.strip():
        return None, "empty"
    if "\\ud" in text or "\\uD" in text:
        # Half a character outside the basic plane is none.
        text = _LONE.sub(r"\\ufffd", text)
    pairs: list[int] = []

    def object_(p: list) -> dict:
        pairs.append(len(p))
        return dict(p)

    try:
        value = json.loads(text, object_pairs_hook=object_, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None, "no JSON"
    if not isinstance(value, dict):
        return None, "no object"
    # The outermost object is closed last.
    return value, "repeated field" if pairs[-1] > len(value) else None


def kind_of(value) -> int:
    """Bit of the value's kind; integers and decimals are one kind."""
    if value is None:
        return 0
    if isinstance(value, bool):
        return KINDS["flag"]
    return KINDS["text"] if isinstance(value, str) else KINDS["number"] if isinstance(value, (int, float)) else KINDS["list"] if isinstance(value, list) else KINDS["object"]


def canonical(value) -> str | None:
    """A value as text, the same for equal values of one kind; None for null."""
    if value is None:
        return None
    if isinstance(value, str):
        return "s" + value
    if isinstance(value, float):
        return f"n{int(value)}" if value.is_integer() and abs(value) < 9e15 else f"n{value!r}"
    return f"n{value}" if isinstance(value, int) and not isinstance(value, bool) else "j" + json.dumps(value, sort_keys=True)


def own_kind(value, sql: str):
    """The value for a column of this type if it is of the column's own kind, else None."""
    if isinstance(value, str):
        return value if sql == "string" else None
    if isinstance(value, bool):
        return value if sql == "boolean" else None
    if isinstance(value, (int, float)):
        if sql == "double":
            return float(value) if abs(value) < 1.7e308 else None
        if sql in _WHOLE and (isinstance(value, int) or value.is_integer()) and _WHOLE[sql][0] <= value <= _WHOLE[sql][1]:
            return int(value)
    return None


def lenient(value, sql: str):
    """The value read for a column of this type from another kind, None if it cannot be: texts that are one number, numbers as text, flags as 1 and 0, an object's "value", a list's only element."""
    got = own_kind(value, sql)
    if got is not None or value is None:
        return got
    if isinstance(value, dict):
        return lenient(value["value"], sql) if "value" in value and not isinstance(value["value"], (dict, list)) else None
    if isinstance(value, list):
        return lenient(value[0], sql) if len(value) == 1 and not isinstance(value[0], (dict, list)) else None
    if sql == "string":
        return json.dumps(value)
    if isinstance(value, bool):
        return own_kind(int(value), sql)
    if isinstance(value, str):
        text = value.strip()
        if sql == "boolean":
            return {"true": True, "false": False}.get(text.lower())
        try:
            number = float(text) if sql == "double" or not text.lstrip("+-").isdigit() else int(text)
        except ValueError:
            return None
        # float() also takes what is no number in JSON.
        return own_kind(number, sql) if math.isfinite(number) and "_" not in text else None
    return {0: False, 1: True}.get(value) if sql == "boolean" else None


def _names_of(target: Mapping[str, str], approved: Mapping[str, str]) -> dict[str, list[str]]:
    """Per column the field names that stand for it: its own, then the others by name."""
    return {c: [c, *sorted(f for f, of in approved.items() if of == c and f not in target)] for c in target}


def _check(columns: Iterable[str], target: Mapping[str, str]) -> None:
    clash = {c.lower() for c in (*ADDED, *target)} & {c.lower() for c in columns}
    if clash or len({c.lower() for c in target}) < len(target):
        raise ValueError(f"columns named twice: {sorted(clash)}")
    unknown = set(target.values()) - set(_ARROW)
    if unknown:
        raise ValueError(f"no such column types: {sorted(unknown)}")


def ingest(lines: DataFrame, payload: str, target: Mapping, of: str | None = None) -> DataFrame:
    """lines without payload, and: the target's typed columns, _rescued, _seen, _reason.

    of: column that tells each line's table; target is then a mapping of tables
    to their targets (a table that is not named has none), each line is held
    against its own, and no typed columns are given, as the tables' differ.

    A target column holds the line's value where that is of the column's own
    kind; other values of it, and fields outside the target, are kept as they
    are in _rescued (JSON; NULL if there is none). _seen lists every field the
    line names with place ("typed", "rescued" or "null"), kind (bit) and digest
    of its value (NULL for null). Of a field named more than once the last
    counts, and _reason says so. Lines that are NULL, blank, no JSON or no JSON
    object have NULL in all of these but _reason, which says why.
    """
    rest = [c for c in lines.columns if c != payload]
    targets = {None: dict(target)} if of is None else {k: dict(v) for k, v in target.items()}
    handed = list(target) if of is None else []
    for t in targets.values():
        _check(rest if of is None else [], t)
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest) + "".join(f", `{c}` {targets[None][c]}" for c in handed) + ", _rescued string, _told array<struct<name:string,place:string,kind:int,value:string>>, _reason string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            typed: dict[str, list] = {c: [] for c in handed}
            rescued, reasons, offsets = [], [], [0]
            names, places, bits, values = [], [], [], []
            absent = []
            tables = batch.column(of).to_pylist() if of else [None] * batch.num_rows
            for text, table in zip(batch.column(payload).to_pylist(), tables, strict=True):
                wanted = targets.get(table, {})
                fields, reason = read_line(text)
                reasons.append(reason)
                absent.append(fields is None)
                left = {}
                got = {}
                for name, value in (fields or {}).items():
                    place = "null"
                    if value is not None:
                        sql = wanted.get(name)
                        own = own_kind(value, sql) if sql else None
                        if own is None:
                            place, left[name] = "rescued", value if value == value and value not in _ENDLESS else repr(value)
                        else:
                            place, got[name] = "typed", own
                    names.append(name)
                    places.append(place)
                    bits.append(kind_of(value))
                    values.append(canonical(value))
                for c in handed:
                    typed[c].append(got.get(c))
                rescued.append(json.dumps(left, ensure_ascii=False) if left else None)
                offsets.append(len(names))
            told = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.string()), pa.array(bits, pa.int32()), pa.array(values, pa.string())], ["name", "place", "kind", "value"])
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), told, mask=pa.array(absent))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(typed[c], _ARROW[targets[None][c]]) for c in handed), pa.array(rescued, pa.string()), listed, pa.array(reasons, pa.string())], [*rest, *handed, "_rescued", "_told", "_reason"])

    rows = lines.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{payload}`")).mapInArrow(read, schema)
    seen = F.transform("_told", lambda x: F.struct(x["name"].alias("name"), x["place"].alias("place"), x["kind"].alias("kind"), F.when(x["value"].isNotNull(), F.xxhash64(x["value"])).alias("digest")))
    return rows.select(*[F.col(f"`{c}`") for c in (*rest, *handed)], "_rescued", seen.alias("_seen"), "_reason")


def replay(ingested: DataFrame, target: Mapping[str, str], approved: Mapping[str, str] | None = None) -> DataFrame:
    """Promotes rescued values to their typed columns, which may be new ones of the target.

    approved: field name -> target column it stands for. A column without a
    value takes the first of its own name, then of the other names in order,
    that can be read as its type (see lenient); what is used leaves _rescued,
    all else stays in it. Values already there are kept. No other row is read
    in Python than those with rescued values.
    """
    names = _names_of(target, approved or {})
    have = [c for c in target if c in ingested.columns]
    kinds = {f.name: f.dataType.simpleString() for f in ingested.schema.fields}
    if any(kinds[c] != target[c] for c in have):
        raise ValueError("a column's type is not that of the target")
    columns = [*ingested.columns, *(c for c in target if c not in ingested.columns)]
    schema = ", ".join(f"`{c}` {target.get(c, kinds.get(c))}" for c in columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: batch.column(c).to_pylist() if c in have else [None] * batch.num_rows for c in target}
            rescued = batch.column("_rescued").to_pylist()
            for n, text in enumerate(rescued):
                left = json.loads(text)
                for c, of in names.items():
                    if out[c][n] is None:
                        for name in of:
                            value = lenient(left.get(name), target[c])
                            if value is not None:
                                out[c][n] = value
                                del left[name]
                                break
                rescued[n] = json.dumps(left, ensure_ascii=False) if left else None
            yield pa.RecordBatch.from_arrays([pa.array(out[c], _ARROW[target[c]]) if c in out else pa.array(rescued, pa.string()) if c == "_rescued" else batch.column(c) for c in columns], columns)

    plain = ingested.where("_rescued is null").select(*[F.col(f"`{c}`") if c in kinds else F.lit(None).cast(target[c]).alias(c) for c in columns])
    return plain.unionByName(ingested.where("_rescued is not null").mapInArrow(read, schema))


def numbered(files: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """files with n: their place within by, from 1. Sorted by range; a series' place in a range follows from how many of it lie in those before."""
    placed = stored(files.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return placed.withColumn("_in", inside).join(before, [*by, "_range"]).withColumn("n", (F.col("_before") + F.col("_in")).cast("bigint")).drop("_range", "_in", "_before")


def _signatures(lines: DataFrame, wanted: DataFrame, series: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """series, n, side, name, held, s1, s2: what a lost (side 0) or gained (side 1) field holds in the records that both files have."""
    sides = stored(wanted.select(*series, "n", "side", "file").distinct())
    rows = lines.where("_id is not null").join(sides, [*series, "file"]).select(*series, "n", "side", "_id", F.struct(*newest).alias("_newest"), F.transform("_seen", lambda x: F.struct(x["name"].alias("name"), x["digest"].alias("digest"))).alias("_values"))
    # Of repeated lines of a record the latest counts; both sides of a record meet here.
    of = lambda side: F.max_by(F.when(F.col("side") == side, F.col("_values")), F.when(F.col("side") == side, F.col("_newest"))).alias(f"_{side}")
    both = rows.groupBy(*series, "n", "_id").agg(of(0), of(1)).where("_0 is not null and _1 is not null")
    tagged = lambda side: F.transform(f"_{side}", lambda x: F.struct(F.lit(side).alias("side"), x["name"].alias("name"), x["digest"].alias("digest")))
    each = both.select(*series, "n", "_id", F.explode(F.concat(tagged(0), tagged(1))).alias("x")).select(*series, "n", "_id", "x.*").where("digest is not null")
    kept = each.join(wanted.select(*series, "n", "side", "name"), [*series, "n", "side", "name"], "left_semi")
    return kept.groupBy(*series, "n", "side", "name").agg(F.count(F.lit(1)).alias("held"), F.bit_xor(F.xxhash64("_id", "digest")).alias("s1"), F.bit_xor(F.xxhash64("digest", "_id", F.lit(1))).alias("s2"))


def _renames(lines: DataFrame, diff: DataFrame, series: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """series, n, prev_name, new_name: a lost and a gained field that agree in every record of both files.

    Fields agree if they hold equal values for the same records, that is, if
    their signatures are equal: an equality join, no comparison of all with all.
    """
    one_sided = diff.where("here != before")
    both = one_sided.groupBy(*series, "n").agg(F.bool_or("here").alias("g"), F.bool_or("before").alias("l")).where("g and l").select(*series, "n")
    wanted = stored(one_sided.join(both, [*series, "n"], "left_semi").select(*series, "n", F.col("here").cast("int").alias("side"), F.when(F.col("here"), F.col("file")).otherwise(F.col("prev_file")).alias("file"), "name"))
    signed = _signatures(lines, wanted, series, newest)
    # Should several have one signature, they are paired in order of their names.
    place = F.row_number().over(Window.partitionBy(*series, "n", "side", "held", "s1", "s2").orderBy("name"))
    signed = stored(signed.withColumn("_at", place))
    old = signed.where("side = 0").withColumnRenamed("name", "prev_name").drop("side")
    new = signed.where("side = 1").withColumnRenamed("name", "new_name").drop("side")
    return old.join(new, [*series, "n", "held", "s1", "s2", "_at"]).select(*series, "n", "prev_name", "new_name")


def _type_changes(fields: DataFrame, diff: DataFrame, renames: DataFrame, series: Sequence[str]) -> DataFrame:
    """series, n, name: in this file and the one before, and holding another kind than when last it held any.

    A field's life under one name from one rename to the next is a segment, told
    by the file in which it begins (0: no rename). What a segment last held
    follows by an as-of join; what it held before it began is what the segment
    it was renamed from last held, or was told by its own beginning.
    """
    key = [*series, "name"]
    begun = renames.select(*series, "n", F.col("new_name").alias("name"), F.col("prev_name").alias("parent"))
    ended = renames.select(*series, "n", F.col("prev_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    # A name that is given up and taken in one file begins as what took it.
    marks = stored(begun.unionByName(ended).groupBy(*key, "n").agg(F.max("parent").alias("parent")))
    starts = marks.groupBy(*key).agg(F.collect_list("n").alias("_starts"))
    last = lambda ok: F.coalesce(F.array_max(F.filter("_starts", ok)), F.lit(0).cast("bigint"))
    parted = lambda df: df.join(starts, key, "left").withColumn("segment", last(lambda a: a <= F.col("n"))).drop("_starts")
    held = parted(fields.where("kinds != 0").select(*key, "n", "kinds"))
    asked = parted(diff.where("here and before and kinds != 0").select(*key, "n", "kinds")).withColumn("_at", F.col("n") - 1)
    found = asof(asked, held.withColumnRenamed("kinds", "was"), "_at", "n", "was", [*key, "segment"], width=256).drop("_at")
    # Segments with what they last held and the segment they came from.
    final = held.groupBy(*key, "segment").agg(F.max_by("kinds", "n").alias("final"))
    froms = marks.where("parent is not null").select(*series, F.col("name").alias("child"), F.col("n").alias("begin"), F.col("parent").alias("name"))
    froms = froms.join(starts, key, "left").withColumn("segment", last(lambda a: a < F.col("begin"))).drop("_starts")
    links = stored(froms.join(final, [*key, "segment"], "left").select(*series, "child", "begin", "name", "segment", "final"))
    # A parent that held nothing hands on what it was told; chains of these are shortened by half a round.
    while not links.where("final is null and segment > 0").isEmpty():
        up = links.select(*series, F.col("child").alias("name"), F.col("begin").alias("segment"), F.col("name").alias("_name"), F.col("segment").alias("_segment"), F.col("final").alias("_final"))
        open_ = F.col("final").isNull() & (F.col("segment") > 0)
        joined = links.join(up, [*series, "name", "segment"], "left")
        # Without a parent of its own nothing was handed on.
        links = stored(joined.select(*series, "child", "begin", F.when(open_, F.col("_name")).otherwise(F.col("name")).alias("name"), F.when(open_, F.coalesce("_segment", F.lit(0).cast("bigint"))).otherwise(F.col("segment")).alias("segment"), F.when(open_, F.col("_final")).otherwise(F.col("final")).alias("final")))
    told = links.select(*series, F.col("child").alias("name"), F.col("begin").alias("segment"), "final")
    known = found.join(told, [*key, "segment"], "left").withColumn("was", F.coalesce("was", "final"))
    return known.where(F.col("kinds").bitwiseAND(F.bitwise_not("was")) != 0).select(*series, "n", "name")


def changes(ingested: DataFrame, series: Sequence[str], file: str, order: str, record: str, newest: Sequence[str]) -> DataFrame:
    """series, file, prev_name, new_name, change_kind of ingested rows.

    series: columns that name a series of files; order: column that orders them
    (one value a file); record: the field that identifies a record; newest:
    columns by which the latest of repeated lines of a record is taken. The
    first file of a series has no changes; files without a line that was read
    do not count. Rows with NULL in series or file take no part.
    """
    known = " and ".join(f"`{c}` is not null" for c in (*series, file))
    id_ = F.get(F.filter("_seen", lambda x: x["name"] == record), F.lit(0))["digest"]
    by, new = [f"_s{i}" for i in range(len(series))], [f"_w{i}" for i in range(len(newest))]
    # Written once, compressed: profiles and renames are both made from it.
    named = [*(F.col(f"`{c}`").alias(x) for c, x in zip(series, by, strict=True)), F.col(f"`{file}`").alias("file"), F.col(f"`{order}`").alias("order"), *(F.col(f"`{c}`").alias(x) for c, x in zip(newest, new, strict=True))]
    lines = stored(ingested.where("_seen is not null").where(known).select(*named, id_.alias("_id"), F.transform("_seen", lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["digest"].alias("digest"))).alias("_seen")))
    each = lines.select(*by, "file", "order", F.explode("_seen").alias("x")).select(*by, "file", "order", "x.name", "x.kind")
    per_file = stored(each.groupBy(*by, "file", "name").agg(F.bit_or("kind").alias("kinds"), F.min("order").alias("order")))
    files = stored(numbered(per_file.groupBy(*by, "file").agg(F.min("order").alias("order")), by, ["order", "file"]).select(*by, "file", "n"))
    fields = stored(per_file.join(files, [*by, "file"]).select(*by, "n", "name", "kinds"))
    here = fields.select(*by, "n", "name", "kinds", F.lit(True).alias("here"))
    before = fields.select(*by, (F.col("n") + 1).alias("n"), "name", F.lit(None).cast("int").alias("kinds"), F.lit(False).alias("here"))
    sides = here.unionByName(before).groupBy(*by, "n", "name").agg(F.bool_or("here").alias("here"), F.bool_or(~F.col("here")).alias("before"), F.max("kinds").alias("kinds"))
    diff = stored(sides.join(files, [*by, "n"]).join(files.select(*by, (F.col("n") + 1).alias("n"), F.col("file").alias("prev_file")), [*by, "n"]))
    renames = stored(_renames(lines, diff, by, new))
    used = renames.select(*by, "n", F.col("prev_name").alias("name"), F.lit(False).alias("here")).unionByName(renames.select(*by, "n", F.col("new_name").alias("name"), F.lit(True).alias("here")))
    plain = diff.where("here != before").join(used, [*by, "n", "name", "here"], "left_anti")
    says = lambda col: F.when(col, F.col("name")).otherwise(F.lit(""))
    plain = plain.select(*by, "n", says(~F.col("here")).alias("prev_name"), says(F.col("here")).alias("new_name"), F.when(F.col("here"), "added").otherwise("removed").alias("change_kind"))
    moved = renames.withColumn("change_kind", F.lit("renamed"))
    kinds = _type_changes(fields, diff, renames, by).select(*by, "n", F.col("name").alias("prev_name"), F.col("name").alias("new_name"), F.lit("type_changed").alias("change_kind"))
    found = plain.unionByName(moved).unionByName(kinds).join(files, [*by, "n"])
    return found.select(*(F.col(x).alias(c) for c, x in zip(series, by, strict=True)), F.col("file").alias(file), "prev_name", "new_name", "change_kind")


def plain_name(name: Column) -> Column:
    """A field name without case, underscores and hyphens."""
    return F.lower(F.regexp_replace(name, "[_-]", ""))


def linked(renames: DataFrame, names: Iterable[str]) -> list[tuple[str, str]]:
    """Those renames (prev_name, new_name) that lead to or from one of the names, over any number of steps; others, of however many fields, stay where they are."""
    known, found = set(names), set()
    pairs = renames.select("prev_name", "new_name").distinct()
    while True:
        near = {tuple(r) for r in pairs.where(F.col("prev_name").isin(list(known)) | F.col("new_name").isin(list(known))).collect()}
        reached = known | {x for p in near for x in p}
        if near == found and reached == known:
            return sorted(found)
        known, found = reached, near


def approvals(renamed: Iterable[tuple[str, str]], target: Iterable[str], alike: Iterable[str] = ()) -> dict[str, str]:
    """Fields that stand for a target column: those linked to it by reported
    renames or spelt like it but for case and underscores (``alike``: field
    names to look at). A field linked to two columns stands for none."""
    plain = lambda s: s.replace("_", "").replace("-", "").lower()
    links: dict[str, set[str]] = {}
    by_plain: dict[str, list[str]] = {}
    pairs = [(a, b) for a, b in renamed]
    for name in {*target, *alike, *(x for p in pairs for x in p)}:
        by_plain.setdefault(plain(name), []).append(name)
        links.setdefault(name, set())
    for a, b in [*pairs, *((of[0], x) for of in by_plain.values() for x in of[1:])]:
        links[a].add(b)
        links[b].add(a)
    wanted, out = set(target), {}
    for name in links:
        group, todo = {name}, [name]
        while todo:
            for x in links[todo.pop()] - group:
                group.add(x)
                todo.append(x)
        columns = group & wanted
        if len(columns) == 1 and name not in wanted:
            out[name] = next(iter(columns))
    return out
