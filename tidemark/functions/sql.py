"""The document functions for SQL: ``register`` makes them known to a session.

They run in Arrow batches; what can't be read gives null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions import documents
from tidemark.sources import prometheus

_NORMAL = "struct<uid:string,resource_version:string,api_version:string,labels:map<string,string>,actors:array<string>,json:string,sha256:string>"
_UNREADABLE = (ValueError, TypeError, AttributeError, KeyError, RecursionError)


def _or_null(f):
    def run(*texts):
        if texts[0] is None:
            return None
        try:
            return f(*texts)
        except _UNREADABLE:
            return None

    return run


def _normalize(text: str, paths: list[str] | None) -> dict:
    return documents.normalize(json.loads(text), documents.Redaction(paths if paths is not None else ()))


def _diff(old: str, new: str) -> str:
    return documents.canonical_json(documents.json_diff(json.loads(old), json.loads(new)))


def _patched(text: str, patch: str) -> str:
    return documents.canonical_json(documents.json_patch(json.loads(text), json.loads(patch)))


class ParseMetrics:
    """Samples of a text in the exposition format, a row each; lines that can't be read are left out."""

    def eval(self, text: str) -> Iterator[tuple]:
        for line in (text or "").splitlines():
            try:
                found = prometheus.parse_line(line)
            except ValueError:
                continue
            if found:
                yield found


def register(spark: SparkSession) -> None:
    """normalize_object(json, paths), json_diff(old, new), json_patch_apply(json, patch), canonical_json(json), and the table function parse_metrics(text)."""
    scalar = {
        "normalize_object": (_normalize, _NORMAL),
        "json_diff": (_diff, "string"),
        "json_patch_apply": (_patched, "string"),
        "canonical_json": (lambda text: documents.canonical_json(json.loads(text)), "string"),
    }
    for name, (f, kind) in scalar.items():
        spark.udf.register(name, F.udf(_or_null(f), kind, useArrow=True))
    spark.udtf.register("parse_metrics", F.udtf(ParseMetrics, returnType="name string, labels map<string,string>, value double"))
