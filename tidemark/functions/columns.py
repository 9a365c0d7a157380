"""Column builders of the queries: JSON reads with defaults, time filters and buckets, display texts."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_str(doc: str | Column, *path: str) -> Column:
    """The string at a path, '' for what is missing or no string."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    value = F.try_variant_get(F.try_parse_json(doc), "$." + ".".join(path), "variant")
    return F.coalesce(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")), F.lit(""))


def json_uint(doc: str | Column, *path: str) -> Column:
    """The whole number at a path, 0 for what is missing."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    return F.coalesce(F.try_variant_get(F.try_parse_json(doc), "$." + ".".join(path), "bigint"), F.lit(0).cast("bigint"))


def first_filled(*columns: Column) -> Column:
    """The first of the columns that isn't ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def subject(field: str) -> Column:
    """A field of the object that an Event is about, under either API's spelling."""
    return first_filled(json_str("data", "involvedObject", field), json_str("data", "regarding", field))


def occurrences() -> Column:
    return F.greatest(json_uint("data", "count"), json_uint("data", "deprecatedCount"), json_uint("data", "series", "count"))


def managers(actors: str | Column = "actors") -> Column:
    return F.array_join(F.array_sort(actors), ", ")


def union_of(actors: str = "actors") -> Column:
    """Aggregate: all distinct elements of an array column, sorted; sets are merged before the shuffle."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(actors))))


def change_text(sizes: bool = True) -> Column:
    """The patch, or a note of the full state, or ''."""
    note = F.concat(F.lit("(full state, "), F.octet_length("data").cast("string"), F.lit(" bytes)")) if sizes else F.lit("(full state)")
    return F.when(F.col("diff") != "", F.col("diff")).when(F.col("data") != "", note).otherwise("")


def identity_key() -> Column:
    """One text for an object, over all versions of its API; joins and groups use the columns."""
    return F.concat_ws("|", "api_group", "kind", F.concat_ws("/", "namespace", "name"))


def scope_prefix(group: str, kind: str, namespace: str) -> str:
    """What the keys of a scope's objects begin with; without a namespace, of all namespaces."""
    return f"{group}|{kind}|" + (f"{namespace}/" if namespace else "")


def literal_like(df: DataFrame, column: str, value: datetime) -> Column:
    """A time as a literal of the column's own type, so that the comparison is pushed to the scan."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(df.schema[column].dataType)


def between(df: DataFrame, start: datetime, end: datetime, column: str = "ts") -> Column:
    return (F.col(column) >= literal_like(df, column, start)) & (F.col(column) <= literal_like(df, column, end))


def bucket(seconds: int, column: str = "ts") -> Column:
    """Start of the interval of ``seconds``, aligned to the epoch."""
    return F.window(column, f"{seconds} seconds")["start"]


_MACRO = re.compile(r"\$__(\w+)(?:\((\w+)\))?")
_VARIABLE = re.compile(r"\$\{(\w+)(?::(\w+))?\}|\$(\w+)")


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def expand(sql: str, variables: dict[str, list[str]], start: datetime, end: datetime, seconds: int) -> str:
    """Spark SQL for a dashboard statement: time macros and ``${name:format}`` variables; unknown ones are errors."""
    times = {k: f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S.%f}'" for k, v in (("from", start), ("to", end))}

    def macro(m: re.Match) -> str:
        name, column = m.groups()
        known = {"fromTime": times["from"], "toTime": times["to"], "interval_s": str(seconds)}
        if column:
            known = {"timeFilter": f"({column} >= {times['from']} AND {column} <= {times['to']})", "timeInterval": f"window({column}, '{seconds} seconds').start"}
        if name not in known:
            raise ValueError(f"unknown macro {m[0]!r}")
        return known[name]

    def variable(m: re.Match) -> str:
        name, form = m[1] or m[3], m[2] or "raw"
        if name not in variables:
            raise ValueError(f"unknown variable {name!r}")
        values = variables[name]
        if form in ("sqlstring", "singlequote"):
            return ", ".join(map(quoted, values))
        if form in ("csv", "raw"):
            return ",".join(values)
        raise ValueError(f"unknown format {form!r} of variable {name!r}")

    return _VARIABLE.sub(variable, _MACRO.sub(macro, sql))


_PARAMETER = re.compile(r"(?<!\$)\{(\w+):\s*(\w+)[^{}]*\}")
#: What a parameter is that nobody gave, by the beginning of its type's name.
_UNSET = {"String": "", "LowCardinality": "", "Date": datetime(1970, 1, 1), "UInt": 0, "Int": 0, "Float": 0.0, "Bool": False}


def bound(sql: str, values: dict[str, object] | None = None) -> tuple[str, dict[str, object]]:
    """A statement with ``{name:Type}`` parameters as one with named markers, and its arguments for ``spark.sql``.

    Parameters without a value get that of their type; an unknown type or a value that no parameter has is an error.
    """
    given, arguments = values or {}, {}
    for name, kind in _PARAMETER.findall(sql):
        default = next((v for k, v in _UNSET.items() if kind.startswith(k)), None)
        if name not in given and default is None:
            raise ValueError(f"parameter {name!r}: unknown type {kind!r}")
        arguments[name] = given.get(name, default)
    if unknown := given.keys() - arguments.keys():
        raise ValueError(f"no parameters {sorted(unknown)}")
    return _PARAMETER.sub(lambda m: f":{m[1]}", sql), arguments
