"""Samples from the text format of metrics endpoints."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_NAME = r"[a-zA-Z_:][a-zA-Z0-9_:]*"
_LABEL = re.compile(rf'\s*({_NAME})\s*=\s*"((?:[^"\\]|\\.)*)"\s*(,|$)')
_SAMPLE = re.compile(rf"({_NAME})\s*(?:\{{(.*)\}})?\s+(\S+)(?:\s+(-?\d+))?\s*$")
_ESCAPED = {"n": "\n", "\\": "\\", '"': '"'}


def parse_line(line: str) -> tuple[str, dict[str, str], float] | None:
    """(name, labels, value), or None for comments and blank lines; raises ValueError for anything else."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    m = _SAMPLE.match(line)
    if not m:
        raise ValueError(f"not a sample: {line!r}")
    labels, at, text = {}, 0, (m[2] or "").strip()
    while at < len(text):
        part = _LABEL.match(text, at)
        if not part:
            raise ValueError(f"not a label: {text[at:]!r}")
        labels[part[1]] = re.sub(r"\\(.)", lambda e: _ESCAPED.get(e[1], e[0]), part[2])
        at = part.end()
    return m[1], labels, float(m[3].replace("Inf", "inf"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("name", pa.string()), ("labels", pa.map_(pa.string(), pa.string())), ("value", pa.float64()), ("line", pa.string())])
    for batch in batches:
        out = []
        for line in batch.column(0).to_pylist():
            try:
                found = parse_line(line or "")
            except ValueError:
                out.append({"name": None, "labels": None, "value": None, "line": line})
                continue
            if found:
                out.append({"name": found[0], "labels": found[1], "value": found[2], "line": None})
        yield pa.RecordBatch.from_pylist(out, kind)


def parse(lines: DataFrame) -> DataFrame:
    """name, labels, value of each sample in a column ``value`` of lines; what can't be read has only ``line``."""
    return lines.select("value").mapInArrow(_rows, "name string, labels map<string,string>, value double, line string")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))
