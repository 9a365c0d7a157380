"""The classifier as a stateful streaming operator, and its sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.cdc import BEFORE, KEY, OUT, Classifier, State, as_states, observed, quarantined
from tidemark.sources.schema import EVENT_TYPES
from tidemark.sources.tables import append_states

_STATE = "uid string, sha256 string, api_version string, json string, run long, at long, epoch long"
_COLUMNS = [part.split()[0] for part in OUT.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Processor(StatefulProcessor):
    """One object's state; all rows of a key in a batch are sorted before they are judged."""

    def __init__(self, classifier: Classifier) -> None:
        self.classifier = classifier

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        if len(initialState) > 1:
            raise ValueError(f"{len(initialState)} states to start from for {key}")
        row = initialState.iloc[0]
        self.state.update((row.uid, row.sha256, row.api_version or "", None, 0, BEFORE, None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        had = self.state.exists()
        state = State(*self.state.get()) if had else None
        out = []
        observations = [o for frame in rows for o in frame.astype(object).where(frame.notna(), None).to_dict("records")]
        for o in sorted(observations, key=lambda o: (o["ts_ns"], o["seq"])):
            state, more = self.classifier.step(state, o)
            out += more
        if state is not None:
            self.state.update((state.uid, state.sha256, state.api_version, state.json, state.run, state.at, None if state.epoch is None else int(state.epoch)))
        elif had:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def classify_stream(observations: DataFrame, classifier: Classifier | None = None, seed: DataFrame | None = None) -> DataFrame:
    """Rows of a stream of observations; ``seed`` (KEY, uid, sha256, api_version) is the state to start from."""
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    start = seed.select(*KEY, "uid", "sha256", "api_version").groupBy(*KEY) if seed is not None else None
    return observed(observations).groupBy(*KEY).transformWithStateInPandas(Processor(classifier or Classifier()), OUT, "Append", "None", initialState=start)


def counted(rows: DataFrame, name: str = "tidemark") -> DataFrame:
    """The rows, with metrics of what they are in ``observedMetrics`` of the query's progress: one for each event type, failures, bytes of states and patches."""
    kinds = [F.count_if(F.col("event_type") == k).alias(k.lower()) for k in EVENT_TYPES]
    sizes = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(f"{c}_bytes") for c in ("data", "diff")]
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *kinds, F.count("error").alias("failed"), *sizes)


def write_history(rows: DataFrame, path: str, quarantine: str, checkpoint: str, interval: str | None = None):
    """Start the query that appends classified rows, a table for each sink, and sets aside what can't be read.

    A batch that runs again replaces what it had written (its name is that of the
    checkpoint folder and its number).  Without an ``interval`` it takes what there is
    and ends.  The query's progress has the counts of :func:`counted`.
    """
    of = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            append_states(as_states(batch), path, f"{of}-{number}")
            bad = quarantined(batch)
            if not bad.isEmpty():
                bad.withColumn("batch", F.lit(f"{of}-{number}")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(quarantine)
        finally:
            batch.unpersist()

    writer = counted(rows).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def write_scopes(transitions: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Start the query that appends scope transitions."""
    writer = transitions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
