"""Label selectors: parse, one canonical text, and a condition over a map column."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = r"[A-Za-z0-9](?:[A-Za-z0-9._/-]*[A-Za-z0-9])?"
_TERM = re.compile(rf"\s*(?:(?P<absent>!)\s*(?P<k0>{_KEY})|(?P<k1>{_KEY})(?:\s*(?P<op>==|=|!=)\s*(?P<v>[A-Za-z0-9._-]*)|\s+(?P<set>in|notin)\s*\((?P<vs>[^()]*)\))?)\s*(?:,|$)")


def parse(selector: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """(key, operator, values) by key; operators: in, notin, exists, absent."""
    terms, at = [], 0
    text = selector.strip()
    while at < len(text):
        m = _TERM.match(text, at)
        if not m:
            raise ValueError(f"selector {selector!r}: can't be read at {text[at:]!r}")
        if m["absent"]:
            terms.append((m["k0"], "absent", ()))
        elif m["op"]:
            terms.append((m["k1"], "notin" if m["op"] == "!=" else "in", (m["v"],)))
        elif m["set"]:
            terms.append((m["k1"], m["set"], tuple(sorted({v.strip() for v in m["vs"].split(",")}))))
        else:
            terms.append((m["k1"], "exists", ()))
        at = m.end()
    if text.endswith(","):
        raise ValueError(f"selector {selector!r}: ends in a comma")
    return sorted(set(terms))


def canonical(selector: str) -> str:
    """The same text for selectors that say the same in another order or spelling."""

    def show(key: str, op: str, values: tuple[str, ...]) -> str:
        if op in ("exists", "absent"):
            return key if op == "exists" else f"!{key}"
        if len(values) == 1:
            return f"{key}{'=' if op == 'in' else '!='}{values[0]}"
        return f"{key} {op} ({','.join(values)})"

    return ",".join(show(*t) for t in parse(selector))


def from_object(match_labels: dict[str, str] | None = None, expressions: list[dict] | None = None) -> str:
    """Canonical text of a selector given as labels and expressions (key, operator, values)."""
    parts = [f"{k}={v}" for k, v in (match_labels or {}).items()]
    for e in expressions or []:
        op, key, values = e["operator"], e["key"], ",".join(e.get("values") or [])
        parts.append({"In": f"{key} in ({values})", "NotIn": f"{key} notin ({values})", "Exists": key, "DoesNotExist": f"!{key}"}[op])
    return canonical(",".join(parts))


def matches(selector: str, labels: dict[str, str]) -> bool:
    test = {"in": lambda k, v: labels.get(k) in v, "notin": lambda k, v: labels.get(k) not in v, "exists": lambda k, v: k in labels, "absent": lambda k, v: k not in labels}
    return all(test[op](key, values) for key, op, values in parse(selector))


def condition(selector: str, labels: Column | str = "labels") -> Column:
    """The selector over a map column; the empty selector fits everything, a null map has no labels."""
    labels = F.col(labels) if isinstance(labels, str) else labels

    def term(key: str, op: str, values: tuple[str, ...]) -> Column:
        there = F.coalesce(F.map_contains_key(labels, key), F.lit(False))
        if op in ("exists", "absent"):
            return there if op == "exists" else ~there
        fits = there & F.coalesce(F.try_element_at(labels, F.lit(key)).isin(*values), F.lit(False))
        return fits if op == "in" else ~fits

    return reduce(lambda a, b: a & b, [term(*t) for t in parse(selector)], F.lit(True))


def any_condition(selectors: list[str], labels: Column | str = "labels") -> Column:
    """Whether one of several rules' selectors fits."""
    return reduce(lambda a, b: a | b, [condition(s, labels) for s in selectors], F.lit(False))


#: Terms of a selector as data.
TERMS = "array<struct<key:string,op:string,values:array<string>>>"


def parsed(texts: DataFrame) -> DataFrame:
    """``text``, ``canonical`` and ``terms`` of each selector in the first column; distinct selectors are parsed on the workers, and a bad one is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("text", pa.string()), ("canonical", pa.string()), ("terms", pa.list_(pa.struct([("key", pa.string()), ("op", pa.string()), ("values", pa.list_(pa.string()))])))])
        for batch in batches:
            rows = [{"text": t, "canonical": canonical(t), "terms": [{"key": k, "op": op, "values": list(v)} for k, op, v in parse(t)]} for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, kind)

    return texts.select(F.col(texts.columns[0]).alias("text")).distinct().mapInArrow(run, f"text string, canonical string, terms {TERMS}")


def fits(terms: Column, labels: Column | str = "labels") -> Column:
    """Whether a map column has what the terms ask for; a null map has no labels."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    labels = F.coalesce(labels, F.create_map().cast("map<string,string>"))

    def one(t: Column) -> Column:
        there = F.map_contains_key(labels, t["key"])
        among = there & F.coalesce(F.array_contains(t["values"], F.try_element_at(labels, t["key"])), F.lit(False))
        return F.when(t["op"] == "in", among).when(t["op"] == "notin", ~among).when(t["op"] == "exists", there).otherwise(~there)

    return F.forall(terms, one)
