"""State reconstruction: the document of an object at an instant, by replaying its patches, checked by hash."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import literal_like
from tidemark.functions.documents import canonical_json, json_patch, sha256
from tidemark.operators.final import final
from tidemark.sources.schema import IDENTITY, order_of

_OUT = ", ".join(f"{c} string" for c in IDENTITY) + ", uid string, ts timestamp, exists boolean, state string, sha256 string, verified boolean, steps long, error string"


def reconstruct_at(history: DataFrame, at: datetime) -> DataFrame:
    """One row for each object with history at ``at``: its state (null if deleted or without a base) and whether its hash is the recorded one.

    Only rows from the last full state of each object on are sorted and replayed; a
    partition is passed over once.  A deletion ends the incarnation with its uid and
    no other: that of an earlier one, however late it comes, changes nothing.
    """
    time = "ts_ns" if "ts_ns" in history.columns else "ts"
    rows = final(history.where(F.col("ts") <= literal_like(history, "ts", at)), mode="changes")
    of = Window.partitionBy(*IDENTITY)
    base = F.max(F.when(F.col("data") != "", F.col(time))).over(of)
    order = order_of(rows, incarnations=True)
    rows = rows.withColumn("__base", base).where(F.col("__base").isNull() | (F.col(time) >= F.col("__base")))
    columns = [*IDENTITY, "uid", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "Deleted").alias("__end"), "data", "diff", "sha256"]
    dealt = rows.select(*columns, *[c.alias(f"__o{k}") for k, c in enumerate(order)])
    return dealt.repartition(*IDENTITY).sortWithinPartitions(*IDENTITY, *[f"__o{k}" for k in range(len(order))]).mapInArrow(_replay, _OUT)


class _Object:
    """What replaying has come to: ``row`` is the last one of the current incarnation."""

    def __init__(self) -> None:
        self.doc, self.row, self.steps, self.error = None, None, 0, None

    def take(self, r: dict) -> None:
        uid = self.row["uid"] if self.row else None
        if r["__end"]:
            if self.row is None or uid == r["uid"]:
                self.doc, self.row, self.steps, self.error = None, r, 0, None
            return
        try:
            if r["data"]:
                self.doc, self.steps, self.error = json.loads(r["data"]), 0, None  # its own patch is in it already
            elif self.row is not None and (self.row["__end"] or uid not in ("", r["uid"])):
                self.doc, self.steps, self.error = None, 0, None  # another incarnation, whose base isn't here
            elif r["diff"] and self.doc is not None:
                self.doc, self.steps = json_patch(self.doc, json.loads(r["diff"])), self.steps + 1
        except (ValueError, KeyError, TypeError) as e:
            self.doc, self.error = None, f"{type(e).__name__}: {e}"
        self.row = r

    def done(self, key: tuple) -> dict:
        exists = not self.row["__end"]
        text = canonical_json(self.doc) if exists and self.doc is not None and self.error is None else None
        digest = sha256(text) if text is not None else None
        return dict(zip(IDENTITY, key, strict=True)) | {"uid": self.row["uid"], "ts": self.row["ts"], "exists": exists, "state": text, "sha256": digest, "verified": digest == self.row["sha256"] if digest else None, "steps": self.steps, "error": self.error}


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([*[(c, pa.string()) for c in (*IDENTITY, "uid")], ("ts", pa.timestamp("us", "UTC")), ("exists", pa.bool_()), ("state", pa.string()), ("sha256", pa.string()), ("verified", pa.bool_()), ("steps", pa.int64()), ("error", pa.string())])
    key, now = None, _Object()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            of = tuple(r[c] for c in IDENTITY)
            if of != key:
                if key is not None:
                    out.append(now.done(key))
                key, now = of, _Object()
            now.take(r)
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)
    if key is not None:
        yield pa.RecordBatch.from_pylist([now.done(key)], kind)
