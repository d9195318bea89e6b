"""Entity-attribute-value rows as one typed row per entity.

Positional stitching: every entity gets a global ordinal; the values of an
attribute are read into a typed column that is aligned to a range of ordinals
(a segment), and the segments of all attributes over one range are put side by
side by position, without a join or pivot per attribute. Rows are combined to
cells (entity, attribute) before they move, so that an entity that holds a
large part of all rows costs no more than any other; a range holds at most
``segment`` entities times the number of attributes.

A cell is ``unreadable`` where something is stated but nothing of it can be
read as the attribute's type, ``conflict`` where readable rows differ; its
value is then NULL and its issue column says why.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.session import cut

# Texts that state nothing, compared in lower case and trimmed.
STATES_NOTHING = sorted({"n/a", "na", "n.a.", "n.a", "#n/a", "unknown", "none", "null", "nil", "nan", "-", "--", "---", "?", "??", ".", "not recorded", "not available", "not applicable", "not known", "not given", "not stated", "not set", "not specified", "unspecified", "undefined", "missing", "empty", "blank", "tbd", "tba", "to be determined", "no value", "no data", "unset"})
# Words for true and false.
TRUE, FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")

SQL_TYPES = {"string": "string", "int": "bigint", "double": "double", "boolean": "boolean", "timestamp": "timestamp"}
_ARROW = {"string": pa.string(), "int": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
#: Doubles that differ by less than this share of the larger are one value.
SAME = 1e-4


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str
    unit: str | None = None
    factors: dict[str, float] = field(default_factory=dict)
    aliases: tuple[str, ...] = ()


def attributes(df: DataFrame, most: int = 10_000) -> list[Attribute]:
    """Attributes from rows attr, value_type, unit_name, unit_factors, also_known_as: a definition table, at most ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} attributes")
    out = {r["attr"]: Attribute(r["attr"], r["value_type"], r["unit_name"], dict(r["unit_factors"] or {}), tuple(r["also_known_as"] or ())) for r in rows if r["attr"] is not None}
    return [out[k] for k in sorted(out)]


def plain_key(col: Column) -> Column:
    """A key without case, blanks and punctuation."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]", "")


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", "")


def read_double(text: Column, factors: Column, unit: Column) -> Column:
    """One number with or without a unit, in the attribute's unit; NULL if it is anything else."""
    pattern = r"^([+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d{1,3})?)(?U:\s*)(\D.*)?$"
    number = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", ".").try_cast("double")
    named = F.translate(F.regexp_extract(text, pattern, 2), "μ", "µ")
    # No unit means the attribute's own.
    factor = F.when(named == "", F.coalesce(F.try_element_at(factors, unit), F.lit(1.0))).otherwise(F.try_element_at(factors, named))
    value = number * factor
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def read_int(text: Column) -> Column:
    """One number of whole value in plain, grouped, decimal or exponent notation."""
    flat = F.translate(text, "\u00a0\u2009\u202f", "   ")
    grouped = F.regexp_extract(flat, r"^([+-]?\d{1,3}(?:[, ]\d{3})+)(?:\.0*)?$", 1)
    plain = F.regexp_extract(flat, r"^([+-]?\d+)$", 1)
    other = F.regexp_extract(flat, r"^([+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d{1,3})?)$", 1).try_cast("double")
    whole = F.when((other == F.floor(other)) & (F.abs(other) < 9e15), other.try_cast("bigint"))
    return F.when(grouped != "", F.regexp_replace(grouped, "[, ]", "").try_cast("bigint")).when(plain != "", plain.try_cast("bigint")).otherwise(whole)


def read_boolean(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False))


def read_timestamp(text: Column) -> Column:
    """One valid date with time of day, ISO or day.month.year; UTC unless it has an offset."""
    padded = F.regexp_replace(text, r"(^|\.)(\d)(?=\.)", "$10$2")
    iso = F.regexp_replace(padded, r"^(\d{2})\.(\d{2})\.(\d{4}),?(?:T|\s+)(\d.*)$", "$3-$2-$1T$4")
    even = F.regexp_replace(F.regexp_replace(iso, r"^(\d{4}-\d{2}-\d{2})(?:[Tt]|\s+)(\d{1,2}:\d{2})(?![\d:])", "$1T$2:00"), r"^(\d{4}-\d{2}-\d{2})(?:[Tt]|\s+)(?=\d)", "$1T")
    valid = even.rlike(r"^\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,9})?\s*(?:[Zz]|UTC|[+-]\d{2}(?::?\d{2})?)?$")
    zoned = F.regexp_replace(F.regexp_replace(F.translate(even, ",z", ".Z"), r"\s*(?:Z|UTC)$|(?<=[\d])$", "Z"), r"([+-]\d{2}(?::?\d{2})?)Z$", "$1")
    return F.when(valid, zoned.try_cast("timestamp"))


def cells(rows: DataFrame, attrs: list[Attribute], entity: str, key: str, value: str) -> DataFrame:
    """One row per entity and attribute with anything stated: entity, _attr (its
    number), issue, and the value in one of d, l, b, t, s."""
    spark = rows.sparkSession
    names: dict[str, set[int]] = {}
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    for n, a in enumerate(attrs):
        for name in (a.name, *a.aliases):
            names.setdefault(plain(name), set()).add(n)
    # A name of two attributes means neither.
    dictionary = [(name, next(iter(of)), attrs[next(iter(of))].kind, {u.replace("μ", "µ"): float(f) for u, f in attrs[next(iter(of))].factors.items()}, (attrs[next(iter(of))].unit or "").replace("μ", "µ")) for name, of in names.items() if name and len(of) == 1]
    lookup = spark.createDataFrame(dictionary, "_name string, _attr int, _kind string, _factors map<string,double>, _unit string")
    kind = lambda k, col: F.when(F.col("_kind") == k, col)
    text = F.col("_text")
    read = (
        rows.select(F.col(entity).alias("_entity"), plain_key(F.col(key)).alias("_name"), trimmed(F.col(value)).alias("_text"))
        .where("_entity is not null and _text is not null and _text != ''")
        .where(~F.lower("_text").isin(*STATES_NOTHING))
        # The definition table's names: its size does not depend on the rows.
        .join(F.broadcast(lookup), "_name")
        .select(
            "_entity",
            "_attr",
            kind("double", read_double(text, F.col("_factors"), F.col("_unit"))).alias("d"),
            kind("int", read_int(text)).alias("l"),
            kind("boolean", read_boolean(text)).alias("b"),
            kind("timestamp", read_timestamp(text)).alias("t"),
            kind("string", text).alias("s"),
        )
    )
    low = F.lower("s")
    cell = read.groupBy("_entity", "_attr").agg(*[f(c).alias(f"{p}_{c}") for c in "dlbt" for p, f in (("lo", F.min), ("hi", F.max))], F.min(low).alias("lo_s"), F.max(low).alias("hi_s"), F.min("s").alias("s"))
    differs = (
        F.coalesce(F.col("hi_d") - F.col("lo_d") > SAME * F.greatest(F.abs("hi_d"), F.abs("lo_d")), F.lit(False))
        | F.coalesce(F.col("hi_l") != F.col("lo_l"), F.lit(False))
        | F.coalesce(F.col("hi_b") != F.col("lo_b"), F.lit(False))
        | F.coalesce(F.col("hi_t") != F.col("lo_t"), F.lit(False))
        | F.coalesce(F.col("hi_s") != F.col("lo_s"), F.lit(False))
    )
    nothing = F.coalesce(F.col("lo_d").isNull() & F.col("lo_l").isNull() & F.col("lo_b").isNull() & F.col("lo_t").isNull() & F.col("lo_s").isNull(), F.lit(True))
    issue = F.when(nothing, F.lit("unreadable")).when(differs, F.lit("conflict"))
    clear = lambda c: F.when(issue.isNull(), F.col(c))
    return cell.select("_entity", "_attr", issue.alias("issue"), clear("lo_d").alias("d"), clear("lo_l").alias("l"), clear("lo_b").alias("b"), clear("lo_t").alias("t"), clear("s").alias("s"))


def ordinals(rows: DataFrame, entity: str) -> DataFrame:
    """_entity, _ordinal: the distinct entities numbered from 0 in their order.

    Sorted by range, so no task holds them all; the number of a partition's
    first entity comes from the counts of those before it (one row per partition).
    """
    keys = rows.select(F.col(entity).alias("_entity")).where("_entity is not null").distinct()
    # Written, as ranges are sampled: a second computation might cut them elsewhere.
    placed = cut(keys.repartitionByRange("_entity").sortWithinPartitions("_entity")).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    first = rows.sparkSession.createDataFrame(offsets, "_p bigint, _first bigint")
    return placed.withColumn("_p", part).join(F.broadcast(first), "_p").select("_entity", (F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("_ordinal"))


def stitch(rows: DataFrame, attrs: list[Attribute], entity: str, key: str, value: str, segment: int = 1024) -> DataFrame:
    """One row per non-null entity: entity, a typed column per attribute, and
    <attribute>_issue. Entities with no known attribute have NULL throughout."""
    columns = [entity] + [c for a in attrs for c in (a.name, f"{a.name}_issue")]
    if len({c.lower() for c in columns}) < len(columns):
        raise ValueError("an attribute's name clashes with the entity's or another column's")
    kind = rows.schema[entity].dataType.simpleString()
    numbered = ordinals(rows, entity)
    place = [F.floor(F.col("_ordinal") / F.lit(segment)).cast("bigint").alias("_range"), F.pmod("_ordinal", F.lit(segment)).cast("int").alias("_pos")]
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("issue", "string"), ("d", "double"), ("l", "bigint"), ("b", "boolean"), ("t", "timestamp"), ("s", "string"))]
    frame = numbered.select(*place, "_entity", F.lit(-1).alias("_attr"), *empty)
    filled = cells(rows, attrs, entity, key, value).join(numbered, "_entity").select(*place, F.lit(None).cast(kind).alias("_entity"), "_attr", "issue", "d", "l", "b", "t", "s")
    source = {"double": "d", "int": "l", "boolean": "b", "timestamp": "t", "string": "s"}
    schema = f"`{entity}` {kind}, " + ", ".join(f"`{a.name}` {SQL_TYPES[a.kind]}, `{a.name}_issue` string" for a in attrs)

    def assemble(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        attr, pos = table["_attr"].to_numpy(), table["_pos"].to_numpy()
        heads = np.flatnonzero(attr == -1)
        heads = heads[np.argsort(pos[heads])]
        n = len(heads)
        out = [table["_entity"].take(pa.array(heads)).combine_chunks()]
        none = pa.nulls(n, pa.string())
        for k, a in enumerate(attrs):
            at = np.flatnonzero(attr == k)
            # Segment: position -> row of the cell; -1 where the entity states nothing.
            rows_at = np.full(n, -1)
            rows_at[pos[at]] = at
            index = pa.array(rows_at, mask=rows_at < 0)
            out.append(table[source[a.kind]].take(index).combine_chunks().cast(_ARROW[a.kind]) if len(at) else pa.nulls(n, _ARROW[a.kind]))
            out.append(table["issue"].take(index).combine_chunks() if len(at) else none)
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in out], columns)

    return frame.unionByName(filled).groupBy("_range").applyInArrow(assemble, schema)


def issues(wide: DataFrame, attrs: list[Attribute], entity: str) -> DataFrame:
    """entity, attr, issue of the cells of a stitched table that could not be filled without doubt."""
    pairs = F.array(*[F.struct(F.lit(a.name).alias("attr"), F.col(f"{a.name}_issue").alias("issue")) for a in attrs])
    return wide.select(entity, F.explode(pairs).alias("x")).where("x.issue is not null").select(entity, "x.attr", "x.issue")
